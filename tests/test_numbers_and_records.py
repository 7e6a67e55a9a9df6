"""Exact number texts, quantiles, warnings, references and nested records."""

from __future__ import annotations

import json
import random
import struct
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from shelfline import messages
from shelfline.functions.flatten import flattened
from shelfline.functions.guards import fixed_texts, staged
from shelfline.functions.normal import normal_quantile, working_columns
from shelfline.functions.notes import with_financial_notes
from shelfline.functions.planning import Inputs, with_financial, with_planning
from shelfline.operators import daily as days
from shelfline.operators import profile, reports
from shelfline.sources.star import daily_feed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def products(spark):
    return profile.product_profile(days.daily_table(daily_feed(spark, FOLDER), supplier=False)).persist()


def some_numbers() -> list[float]:
    rng = random.Random(1)
    held = [0.0, -0.0, 2.675, 0.125, 0.375, 1.005, 1.115, 0.25, 0.35, 0.05, 0.15, 0.95, 9.95, 9.995, 99.995, 0.5, 1.5, 2.5, 1e-9, 5e-324,
            4503599627370495.5, 4503599627370496.5, 9007199254740993.0, 1e15, 123456789.125, 9e18, -2.675, -0.004, -0.006, 1e-300, 0.045, 0.055]
    held += [n / 8 for n in range(-40, 40)] + [n / 1000 + 0.005 for n in range(3000)] + [rng.uniform(0, 10 ** rng.randint(-3, 9)) for _ in range(2000)]
    while len(held) < 7000:
        x = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        if abs(x) < 9e18:
            held.append(x)
    return held


def test_number_texts_are_those_of_the_double(spark):
    frame = spark.createDataFrame([(x,) for x in some_numbers()], "x double").select(
        "x", F.expr(fixed_texts([("x", 1), ("x", 2), ("x * 100", 1)])).alias("t"))
    for r in frame.collect():
        assert list(r.t) == [f"{r.x:.1f}", f"{r.x:.2f}", f"{r.x * 100:.1f}"] if abs(r.x * 100) < 9e18 else r.t[:2] == [f"{r.x:.1f}", f"{r.x:.2f}"], r.x


def test_missing_numbers_have_no_text(spark):
    assert spark.sql("select cast(null as double) x").select(F.expr(fixed_texts([("x", 1)])).alias("t")).first().t == [None]


def test_quantile_is_the_inverse(spark):
    rng = random.Random(2)
    levels = [1e-300, 1e-20, 1e-9, 0.001, 0.5, 0.9, 0.95, 0.9999999, 1 - 1e-12, *(rng.random() for _ in range(500))]
    frame = spark.createDataFrame([(x,) for x in [*levels, 0.0, 1.0, -1.0, 2.0, None]], "level double")
    found = staged(frame, *normal_quantile("level", "z")).drop(*working_columns("z"))
    assert found.columns == ["level", "z"]
    for r in found.collect():
        if r.level in levels:
            assert r.z == pytest.approx(NormalDist().inv_cdf(r.level), rel=1e-13, abs=1e-16)
        else:
            assert r.z is None


def test_level_per_row_is_the_level_of_the_plan(spark):
    from shelfline.params import Params

    rows = [(10.0, 3.0, 50.0, 7.0, 5.0, 10.0, x) for x in (0.5, 0.9, 0.99)]
    frame = spark.createDataFrame(rows, "mean_demand double, std_dev double, current_inventory double, lead_time_days double, "
                                        "unit_cost double, selling_price double, level double")
    each = with_financial(with_planning(frame, Inputs(level="level")), Inputs(level="level")).collect()
    for r in each:
        params = Params(service_level=r.level)
        fixed = with_financial(with_planning(frame, params=params), params=params).where(F.col("level") == r.level).first()
        for name in ("safety_stock", "reorder_point", "target_stock", "excess_units", "reorder_quantity"):
            assert r[name] == pytest.approx(fixed[name], rel=1e-12)


def noted(spark, **changes):
    row = {"mean_demand": 10.0, "std_dev": 2.0, "current_inventory": 50.0, "lead_time_days": 7.0, "unit_cost": 5.0, "selling_price": 10.0,
           "sold": 3.0} | changes
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} double" for n in row))
    inputs = Inputs(sold="sold")
    return with_financial_notes(with_financial(with_planning(frame, inputs), inputs), inputs).first()


@pytest.mark.parametrize("changes, texts", [
    ({}, []),
    ({"std_dev": None}, ["Insufficient observations for demand variability; replenishment calculations unavailable."]),
    ({"selling_price": 0.0}, ["Zero revenue; gross margin set to 0."]),
    ({"selling_price": 0.0, "sold": 0.0}, []),
    ({"lead_time_days": 0.0, "current_inventory": None}, [
        "Missing current inventory; inventory value, capital tied up, and excess metrics unavailable.",
        "Invalid or unavailable lead time; replenishment calculations unavailable."]),
    ({"mean_demand": 0.0, "std_dev": 0.0}, ["Zero mean demand; days remaining unavailable.",
                                            "Zero demand variability; deterministic stockout logic used."]),
])
def test_planning_and_financial_warnings(spark, changes, texts):
    assert noted(spark, **changes).financial_warnings == texts


def test_sentences():
    """The wording is data: these are literal."""
    assert messages.REASONS["STOCKOUT_ESTIMATE"] == "Estimated stockout probability during lead time: {} (model estimate)."
    assert messages.REASONS["COVERAGE_BELOW_LEAD"] == "Inventory coverage ({} days) is below lead time ({} days)."
    assert messages.REASONS["REORDER_QTY"] == "Recommended reorder quantity: {} units."
    assert messages.REASONS["CATEGORY_HIGH"] == "Category risk is HIGH ({}); review category-level signals."
    assert messages.REASONS["OVERALL_CRITICAL"] == "Overall inventory health is CRITICAL; prioritize interventions."
    assert messages.MISSING_COLUMNS == "Missing required columns: {}"
    assert messages.NO_CATEGORY_SCORES == "No valid product risk scores available for category '{}'."
    assert messages.NO_DATA_FOR_HEALTH == "No category or product data available for overall health."
    assert messages.NO_REFERENCE == "Product-set financial reference unavailable; financial component excluded."


def test_codes_and_texts_belong_together(products):
    for r in products.select("reason_codes", "reasons", "days_remaining", "lead_time_days", "stockout_probability", "reorder_quantity").collect():
        assert len(r.reason_codes) == len(r.reasons)
        for code, text in zip(r.reason_codes, r.reasons):
            assert text.startswith(messages.REASONS[code].split("{}")[0])
        if "COVERAGE_BELOW_LEAD" in r.reason_codes:
            assert r.reasons[0] == f"Inventory coverage ({r.days_remaining:.1f} days) is below lead time ({r.lead_time_days:.1f} days)."
        if "STOCKOUT_ESTIMATE" in r.reason_codes:
            assert f"Estimated stockout probability during lead time: {r.stockout_probability:.1%} (model estimate)." in r.reasons


def test_reference_of_the_product_set(spark):
    table = days.daily_table(daily_feed(spark, FOLDER), supplier=False)
    found = profile.product_profile(table, financial_reference=F.max("revenue_at_risk")).select(
        "product", "revenue_at_risk", "financial_exposure_score").collect()
    most = max(r.revenue_at_risk for r in found if r.revenue_at_risk is not None)
    assert most > 0
    for r in found:
        expected = None if r.revenue_at_risk is None else min(100 * r.revenue_at_risk / most, 100)
        assert r.financial_exposure_score == (None if expected is None else pytest.approx(expected))
    none = profile.product_profile(table, financial_reference=F.max(F.lit(None).cast("double")))
    assert none.where("financial_exposure_score is not null").count() == 0


def test_flattened(spark):
    frame = spark.sql("""select 'k' as id, named_struct('a', 1, 'b', named_struct('c', true, 'd', cast(null as string))) as s,
        array(named_struct('x', 1.23456789D, 'y', map('p', 2, 'q', null)), null) as list, cast(null as array<int>) as none,
        cast(null as struct<z:date>) as gone, map(1, array('u', 'v')) as m, date '2024-01-02' as day""")
    assert [tuple(r) for r in flattened(frame, "id").collect()] == [
        ("k", "s.a", 1.0, None), ("k", "s.b.c", None, "true"), ("k", "s.b.d", None, None), ("k", "list[0].x", 1.234568, None),
        ("k", "list[0].y{p}", 2.0, None), ("k", "list[0].y{q}", None, None),
            ("k", "list[1].x", None, None), ("k", "gone.z", None, None),
        ("k", "m{1}[0]", None, "u"), ("k", "m{1}[1]", None, "v"), ("k", "day", None, "2024-01-02")]


def test_json_contexts_hold_the_records(products):
    name = products.select("product").orderBy("product").first()["product"]
    record = reports.product_record(products, name).first().asDict(recursive=True)
    found = json.loads(reports.product_context(products, name).first().payload)
    assert found == {k: v for k, v in record.items() if v is not None} | {"recommendation_evidence": {
        k: v for k, v in record["recommendation_evidence"].items() if v is not None}}
    brief = reports.brief_context(products)
    assert brief.columns == ["section", "position", "key", "payload"]
    assert {r.section for r in brief.select("section").collect()} == {"overall", "category", "product"}
