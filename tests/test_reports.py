from __future__ import annotations

import json
from datetime import date, timedelta

import pytest

from shelfline.operators import history, profile, reports, scenario
from shelfline.sources.store import stored

COLUMNS = scenario.COMPARED + ["mean_demand", "lead_time_days"]


@pytest.fixture(scope="module")
def base(spark):
    """One product with mean 10, deviation 3 and the usual stock."""
    return spark.createDataFrame(
        [("p", 10.0, 3.0, 60.0, 7.0, 5.0, 10.0)],
        "product string, mean_demand double, std_dev double, current_inventory double, "
        "lead_time_days double, unit_cost double, selling_price double")


@pytest.fixture(scope="module")
def runs(base):
    what_if = scenario.Scenarios([
        ("same", 0.0, 0.0), ("demand", 0.2, None), ("lead", None, 3.0), ("both", 0.2, 3.0),
        ("negative", -1.5, None), ("too_short", None, -10.0)])
    return {r.scenario_id: r for r in scenario.scenario_results(base, what_if).collect()}


def test_scenarios(runs):
    assert runs["demand"].scenario_lead_time_demand == pytest.approx(84)
    assert (runs["demand"].delta_mean_demand, runs["demand"].delta_lead_time_demand) == (
        pytest.approx(2), pytest.approx(14))
    assert (runs["lead"].scenario_lead_time_demand, runs["lead"].delta_lead_time_days) == (100, 3)
    assert (runs["both"].scenario_lead_time_demand, runs["both"].delta_lead_time_demand) == (
        pytest.approx(120), pytest.approx(50))
    assert runs["same"].base_risk_score == pytest.approx(49.8072, abs=1e-4)
    assert runs["demand"].scenario_risk_score == pytest.approx(54.9376, abs=1e-4)
    assert runs["lead"].scenario_risk_score == pytest.approx(54.9994, abs=1e-4)
    assert runs["lead"].direction == "increases"


def test_no_change_changes_nothing(runs):
    same = runs["same"]
    assert all(same[f"delta_{c}"] == 0 for c in COLUMNS) and same.direction == "unchanged"


def test_impossible_scenarios_keep_their_row(runs):
    assert "negative mean demand" in runs["negative"].scenario_error
    assert "non-positive lead time" in runs["too_short"].scenario_error
    for name in ("negative", "too_short"):
        assert all(runs[name][f"scenario_{c}"] is None for c in COLUMNS)
        assert runs[name].base_lead_time_demand == 70


def test_baseline_without_lead_time(base):
    row = scenario.scenario_results(base.selectExpr(
        "product", "mean_demand", "std_dev", "current_inventory", "cast(null as double) lead_time_days",
        "unit_cost", "selling_price"), scenario.Scenarios([("x", 0.1, 1.0)])).first()
    assert "Baseline lead_time_days must be positive" in row.scenario_error


def test_full_grid(base):
    grid = scenario.scenario_results(base)
    assert grid.count() == 151 * 20
    assert grid.where("scenario_error is not null").count() == 0
    assert grid.select("scenario_id").distinct().count() == 3020


@pytest.fixture(scope="module")
def daily(spark):
    from daily_rows import DAILY
    start = date(2024, 1, 1)
    rows = []
    for k in range(14):
        for i in range(30):
            sold = float((i * (k + 3)) % (5 + k))
            rows.append((f"p{k:02d}", start + timedelta(days=i), [None, "A", "B"][k % 3],
                         float(max(0, 120 - 9 * (i % 14))) if k != 5 else None, sold, 5.0, 9.0,
                         float(3 + k)))
    return spark.createDataFrame(rows, DAILY)


@pytest.fixture(scope="module")
def profiles(daily):
    return stored(profile.product_profile(daily), "profile")


def test_every_product_gets_one_action(profiles):
    assert profiles.count() == profiles.select("product").distinct().count() == 14
    assert profiles.where("action is null or priority is null").count() == 0
    assert profiles.where("product = 'p05'").first().action == "UNAVAILABLE"


def test_top_priorities(profiles):
    top = reports.top_priorities(profiles).orderBy("position").collect()
    rank = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "NONE": 4}
    keys = [(rank[r.priority], -r.risk_score, r.product) for r in top]
    assert keys == sorted(keys) and len(top) == 10
    assert all(r.action != "UNAVAILABLE" and len(r.reasons) == len(r.reason_codes) for r in top)
    leading = reports.top_priorities(profiles, k=3, reasons=2).orderBy("position").collect()
    assert [r.reasons for r in leading] == [r.reasons[:2] for r in top[:3]]


def test_explorer(profiles):
    table = reports.product_explorer(profiles)
    assert table.where("category = 'N/A'").count() == 5
    assert {r.product for r in reports.explore(table, search="P0[12]").collect()} == {"p01", "p02"}
    with_issue = reports.explore(table, stockout=True).count()
    assert with_issue + reports.explore(table, stockout=False).count() == 14
    names = [r.product for r in reports.explore(table, sort_by="product").collect()]
    assert names == sorted(names)
    scores = [r.risk_score for r in reports.explore(table).collect()]
    assert scores == sorted(scores, reverse=True)
    assert reports.explore(table, categories=["A"], risk_levels=["LOW", "MEDIUM", "HIGH"]).count() <= 5


def test_context_records(profiles):
    brief = reports.brief_context(profiles).collect()
    assert [r.section for r in brief].count("overall") == 1
    levels = {r.key: json.loads(r.payload)["risk_level"] for r in brief if r.section == "category"}
    assert set(levels) == {"A", "B"}
    contexts = [json.loads(r.payload) for r in brief if r.section == "product"]
    assert len(contexts) == 10 and sorted(c["position"] for c in contexts) == list(range(1, 11))
    one = json.loads(reports.product_context(profiles, contexts[0]["product"]).first().payload)
    assert one["recommendation_reasons"] == contexts[0]["recommendation_reasons"]


def test_enriched_recommendations_keep_action(profiles):
    wide = {r.product: r for r in reports.recommendations_in_context(profiles).collect()}
    plain = {r.product: r for r in profiles.collect()}
    assert {k: (v.action, v.priority) for k, v in wide.items()} == {
        k: (v.action, v.priority) for k, v in plain.items()}
    assert wide["p00"].category_risk_level is None and wide["p01"].category_risk_level is not None
    assert wide["p01"].evidence.category_risk_level == wide["p01"].category_risk_level


def test_detail_of_one_product(profiles):
    one = profile.product_detail(profiles, "p03").collect()
    assert len(one) == 1 and one[0].demand.observation_count == 30
    assert one[0].recommendation.evidence.risk_score == one[0].risk.risk_score


def test_events(spark):
    from daily_rows import DAILY
    stock = [10.0, 12.0, 12.1, 0.0, 5.0, None, 50.0]
    sold = [1.0, 2.0, 3.0, 100.0, 2.0, 4.0, 2.0]
    rows = [("p", date(2024, 1, 1 + i), "A", s, u, 1.0, 2.0, 4.0)
            for i, (s, u) in enumerate(zip(stock, sold))]
    found = {(r.event_type, r.date.day) for r in
             history.inventory_events(spark.createDataFrame(rows, DAILY)).collect()}
    replenished = {d for kind, d in found if kind == "REPLENISHMENT"}
    assert replenished == {1, 5, 7}
    assert ("STOCKOUT", 4) in found and ("DEMAND_SPIKE", 4) in found
    assert {d for kind, d in found if kind == "SAFETY_STOCK_BREACH"} == {1, 2, 3, 4, 5, 7}


def test_history(daily, profiles):
    assert history.demand_history(daily).count() == history.inventory_history(daily).count() == 420
    assert [r.product for r in history.history_products(profiles, limit=5).collect()] == [
        f"p{k:02d}" for k in range(5)]
    assert history.history_products(profiles).count() == profiles.count()
    chosen = history.history_products(profiles, ["Uncategorized"], ["p00", "p01"]).collect()
    assert [r.product for r in chosen] == ["p00"]
