from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shelfline.functions.normal import normal_cdf
from shelfline.functions.planning import Inputs, with_financial, with_planning
from shelfline.functions.recommend import with_recommendation
from shelfline.functions.risk import Signals, weights_used, with_risk
from shelfline.operators.rollup import category_risk, overall_health, with_category_warnings
from shelfline.params import Params

PLAN = ("mean_demand double, std_dev double, current_inventory double, lead_time_days double, "
        "unit_cost double, selling_price double, sold double")


def plan(spark, mean=10.0, sd=3.0, inventory=60.0, lead=7.0, cost=5.0, price=10.0, sold=20.0,
         params=Params()):
    df = spark.createDataFrame([(mean, sd, inventory, lead, cost, price, sold)], PLAN)
    inputs = Inputs(sold="sold")
    return with_financial(with_planning(df, inputs, params), inputs, params).first()


def test_normal_cdf(spark):
    xs = [x / 100 for x in range(-4000, 4001, 7)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", F.expr(normal_cdf("x")).alias("p")).collect()
    worst = max(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) for r in rows)
    assert worst < 1e-15
    nothing = spark.createDataFrame([(None,)], "x double").select(F.expr(normal_cdf("x")))
    assert nothing.first()[0] is None


# mean, sd, inventory, lead -> demand, sd over lead, safety, point, days, p, order, target, excess, short
TABLE = [
    ((10, 3, 60, 7), (70, 7.937254, 13.055621, 83.055621, 6, 0.896144, 23.055621, 313.055621, 0, 10)),
    ((10, 3, 40, 7), (70, 7.937254, 13.055621, 83.055621, 4, 0.999921, 43.055621, 313.055621, 0, 30)),
    ((10, 3, 350, 7), (70, 7.937254, 13.055621, 83.055621, 35, 0.0, 0, 313.055621, 36.944379, 0)),
    ((12, 3, 60, 7), (84, 7.937254, 13.055621, 97.055621, 5, 0.998752, 37.055621, 373.055621, 0, 24)),
    ((10, 3, 60, 10), (100, 9.486833, 15.604452, 115.604452, 6, 0.999988, 55.604452, 315.604452, 0, 40)),
    ((10, 0, 60, 7), (70, 0, 0, 70, 6, 1.0, 10, 300, 0, 10)),
    ((0, 0, 100, 7), (0, 0, 0, 0, None, 0.0, 0, 0, 100, 0)),
    ((10, 3, None, 7), (70, 7.937254, 13.055621, 83.055621, None, None, None, 313.055621, None, None)),
    ((10, 3, 60, None), (None,) * 10),
    ((10, 3, 60, 0), (None,) * 10),
    ((10, 3, 60, -5), (None,) * 10),
    ((10, None, 60, 7), (None,) * 10),
]
NAMES = ["lead_time_demand", "lead_time_sd", "safety_stock", "reorder_point", "days_remaining",
         "stockout_probability", "reorder_quantity", "target_stock", "excess_units",
         "shortage_units"]


@pytest.mark.parametrize("given,expected", TABLE)
def test_planning_table(spark, given, expected):
    row = plan(spark, *[None if v is None else float(v) for v in given])
    for name, value in zip(NAMES, expected):
        assert row[name] == (None if value is None else pytest.approx(value, abs=1e-6)), name


def test_service_level(spark):
    row = plan(spark, params=Params(service_level=0.90))
    assert (row.safety_stock, row.reorder_point) == (
        pytest.approx(10.172000, abs=1e-6), pytest.approx(80.172000, abs=1e-6))
    at_point = plan(spark, inventory=plan(spark).reorder_point)
    assert at_point.stockout_probability == pytest.approx(0.05, abs=1e-9)


def test_financial(spark):
    row = plan(spark, inventory=350.0, cost=6.0, price=10.0, sold=20.0)
    assert (row.daily_revenue, row.daily_cogs, row.daily_profit, row.inventory_value,
            row.capital_tied_up) == (200, 120, 80, 2100, 2100)
    assert row.gross_margin == pytest.approx(0.4)
    short = plan(spark, inventory=40.0)
    assert (short.revenue_at_risk, short.profit_at_risk) == (300, 150)
    assert plan(spark, price=0.0).gross_margin == 0 and plan(spark, sold=None).gross_margin is None


RISK = ("cv double, trend string, trend_strength double, stockout_probability double, "
        "reorder_point double, target_stock double, excess_units double, revenue_at_risk double, "
        "current_inventory double, seasonal_deviation double, reference double")
USUAL = dict(cv=0.8, trend="INCREASING", trend_strength=0.3, stockout_probability=0.8,
             reorder_point=80.0, target_stock=100.0, excess_units=20.0, revenue_at_risk=200.0,
             current_inventory=60.0, seasonal_deviation=0.5, reference=1000.0)


def risk(spark, **changes):
    df = spark.createDataFrame([tuple({**USUAL, **changes}.values())], RISK)
    scored = with_risk(df, Signals(financial_reference="reference"))
    return scored.withColumn("weights", F.expr(weights_used())).first()


def test_risk_score(spark):
    row = risk(spark)
    assert row.risk_score == pytest.approx(46.5) and row.risk_level == "MEDIUM"
    assert row.demand_trend_score == pytest.approx(30)
    assert row.available_weight_sum == pytest.approx(1) and len(row.weights) == 6


def test_risk_without_some_components(spark):
    row = risk(spark, reference=None, seasonal_deviation=None)
    assert row.financial_exposure_score is None and row.seasonality_score is None
    assert row.available_weight_sum == pytest.approx(0.8)
    assert sum(row.weights.values()) == pytest.approx(0.8)
    nothing = risk(spark, cv=None, trend=None, trend_strength=None, stockout_probability=None,
                   excess_units=None, revenue_at_risk=None, seasonal_deviation=None)
    assert nothing.risk_score is nothing.risk_level is None and nothing.weights == {}


def test_risk_limits(spark):
    full = risk(spark, cv=9.0, trend_strength=5.0, stockout_probability=1.0, excess_units=900.0,
                revenue_at_risk=9e9, seasonal_deviation=7.0)
    assert full.risk_score == pytest.approx(100) and full.risk_level == "HIGH"
    assert risk(spark, target_stock=0.0, excess_units=100.0).excess_inventory_score is None
    assert risk(spark, target_stock=0.0, excess_units=0.0).excess_inventory_score == 0
    over = risk(spark, cv=None, trend="DECREASING", trend_strength=-0.3, current_inventory=500.0,
                excess_units=300.0, stockout_probability=0.0, seasonal_deviation=None,
                reference=None)
    assert over.excess_inventory_score == 100 and over.demand_trend_score == pytest.approx(30)
    assert over.risk_level == "LOW"


@pytest.mark.parametrize("trend,inventory,multiplier", [
    ("INCREASING", 60.0, 1.0), ("INCREASING", 200.0, 0.5), ("INCREASING", 90.0, 0.7),
    ("DECREASING", 200.0, 1.0), ("DECREASING", 60.0, 0.5), ("DECREASING", 90.0, 0.7)])
def test_trend_in_context(spark, trend, inventory, multiplier):
    strength = 0.3 if trend == "INCREASING" else -0.3
    row = risk(spark, trend=trend, trend_strength=strength, current_inventory=inventory)
    assert row.demand_trend_score == pytest.approx(30 * multiplier)


def test_stable_trend_needs_no_inventory(spark):
    row = risk(spark, trend="STABLE", trend_strength=0.0, current_inventory=None)
    assert row.demand_trend_score == 20
    assert risk(spark, current_inventory=None).demand_trend_score is None


DECIDE = ("mean_demand double, std_dev double, current_inventory double, lead_time_days double, "
          "unit_cost double, selling_price double, cv double, trend string, "
          "trend_strength double, seasonal_deviation double, observation_count long")


def decide(spark, mean=10.0, sd=3.0, inventory=60.0, lead=7.0, cv=0.3, trend="STABLE",
           strength=0.0, observations=30, **fixed):
    df = spark.createDataFrame([(mean, sd, inventory, lead, 5.0, 10.0, cv, trend, strength, None,
                                 observations)], DECIDE)
    ready = with_risk(with_financial(with_planning(df)))
    for name, value in fixed.items():
        ready = ready.withColumn(name, F.lit(value))
    return with_recommendation(ready).first()


@pytest.mark.parametrize("given,action,priority", [
    (dict(inventory=10.0), "REORDER", "CRITICAL"),
    (dict(inventory=30.0), "REORDER", "HIGH"),
    (dict(inventory=50.0), "REORDER", "MEDIUM"),
    (dict(inventory=40.0, trend="INCREASING", strength=0.4), "REORDER", "HIGH"),
    (dict(mean=0.0, sd=0.0, inventory=50.0, cv=None), "HOLD", "MEDIUM"),
    (dict(mean=0.0, sd=0.0, inventory=5.0, cv=None), "HOLD", "MEDIUM"),
    (dict(mean=0.0, sd=0.0, inventory=500.0, cv=None), "REDUCE", "HIGH"),
    (dict(inventory=400.0, trend="DECREASING", strength=-0.4), "REDUCE", "MEDIUM"),
    (dict(inventory=500.0, trend="DECREASING", strength=-0.4), "REDUCE", "HIGH"),
    (dict(cv=1.5, inventory=150.0), "MONITOR", "MEDIUM"),
    (dict(cv=0.2, inventory=100.0), "NO_ACTION", "NONE"),
    (dict(inventory=150.0, trend="DECREASING", strength=-0.4), "HOLD", "LOW"),
    (dict(lead=None), "UNAVAILABLE", "LOW"),
    (dict(inventory=None), "UNAVAILABLE", "LOW"),
    (dict(observations=0), "UNAVAILABLE", "LOW"),
])
def test_recommendation(spark, given, action, priority):
    row = decide(spark, **given)
    assert (row.action, row.priority) == (action, priority)


# Arms that consistent inputs cannot reach, with values set by hand.
@pytest.mark.parametrize("given,branch,action,priority", [
    (dict(stockout_probability=0.7, excess_units=100.0), "CONFLICT_STOCKOUT", "REORDER", "CRITICAL"),
    (dict(stockout_probability=0.5, excess_units=200.0), "CONFLICT_EXCESS", "REDUCE", "HIGH"),
    (dict(stockout_probability=0.5, excess_units=100.0), "CONFLICT_MONITOR", "MONITOR", "MEDIUM"),
    (dict(stockout_probability=0.1, trend="INCREASING", days_remaining=3.0),
     "INCREASING_LOW_COVER", "REORDER", "HIGH"),
    (dict(stockout_probability=0.1, days_remaining=3.0, risk_level="LOW"),
     "LOW_COVER_BUFFER", "REORDER", "LOW"),
    (dict(stockout_probability=0.1, risk_level="HIGH"), "RISK_HIGH", "MONITOR", "MEDIUM"),
    (dict(stockout_probability=0.1, risk_level="MEDIUM"), "RISK_MEDIUM", "MONITOR", "LOW"),
    (dict(stockout_probability=0.4, days_remaining=4.0), "STOCKOUT_HIGH", "REORDER", "HIGH"),
])
def test_rule_order(spark, given, branch, action, priority):
    row = decide(spark, inventory=100.0, **given)
    assert (row.branch, row.action, row.priority) == (branch, action, priority)


def test_reasons(spark):
    row = decide(spark, inventory=10.0, trend="INCREASING", strength=0.4)
    assert row.reason_codes == ["COVERAGE_BELOW_LEAD", "DEMAND_INCREASING", "REORDER_QTY",
                                "STOCKOUT_ESTIMATE", "REVENUE_AT_RISK", "PROFIT_AT_RISK"]
    assert row.reasons[0] == "Inventory coverage (1.0 days) is below lead time (7.0 days)."
    assert row.reasons[2] == "Recommended reorder quantity: 73.1 units."
    assert row.reasons[3] == ("Estimated stockout probability during lead time: 100.0% "
                              "(model estimate).")
    assert row.reasons[4] == "Revenue at risk from shortage exposure: 600.00."
    elevated = decide(spark, inventory=30.0)
    assert elevated.reason_codes[0] == "STOCKOUT_ELEVATED"
    gone = decide(spark, lead=None)
    assert gone.reason_codes == ["DATA_INCOMPLETE"] and gone.suggested_quantity is None
    assert gone.gate_warnings == ["Lead-time demand unavailable", "Target stock unavailable"]


PRODUCT = ("category string, risk_score double, risk_level string, inventory_value double, "
           "capital_tied_up double, shortage_units double, selling_price double, "
           "excess_inventory_value double, cv double, revenue_at_risk double, "
           "profit_at_risk double")


def products(spark, *rows):
    return spark.createDataFrame(list(rows), PRODUCT)


def test_category_risk(spark):
    df = products(spark,
                  ("A", 50.0, "MEDIUM", 400.0, 400.0, 1.0, 10.0, 0.0, 0.2, 0.0, 0.0),
                  ("A", 70.0, "HIGH", 600.0, 600.0, None, 10.0, 50.0, 0.4, 5.0, 2.0),
                  (None, 90.0, "HIGH", 1.0, 1.0, 1.0, 1.0, 1.0, 0.1, 1.0, 1.0))
    row = category_risk(df, 1000.0).first()
    assert row.risk_score == pytest.approx(72) and row.risk_level == "HIGH"
    assert (row.product_count, row.high_risk_product_count, row.inventory_value,
            row.stockout_exposure, row.excess_inventory_value) == (2, 1, 1000, 10, 50)
    assert row.demand_volatility == pytest.approx(0.3)
    plain = category_risk(df).first()
    assert plain.value_score == 0 and plain.risk_score == pytest.approx(57)


def test_overall_health(spark):
    df = products(spark,
                  ("A", 80.0, "HIGH", 900.0, 900.0, 15.0, 10.0, 0.0, 0.2, 150.0, 75.0),
                  ("A", 60.0, "MEDIUM", 500.0, 500.0, 0.0, 10.0, 100.0, 0.4, 0.0, 0.0),
                  ("B", 10.0, "LOW", 300.0, 300.0, 0.0, 10.0, 0.0, 0.4, 0.0, 0.0),
                  ("B", None, None, None, None, None, 10.0, None, None, None, None))
    levels = {r.category: r.risk_level for r in category_risk(df, 1700.0).collect()}
    assert levels == {"A": "HIGH", "B": "LOW"}
    row = overall_health(df, 1700.0).first()
    assert (row.total_stockout_exposure, row.total_excess_inventory_value,
            row.total_capital_tied_up, row.overall_health_status) == (150, 100, 1700, "ATTENTION")
    assert (row.total_products, row.products_at_risk, row.total_categories,
            row.high_risk_categories) == (4, 2, 2, 1)
    assert (row.total_revenue_at_risk, row.total_profit_at_risk) == (150, 75)
    sums = category_risk(df).agg(F.sum("capital_tied_up"), F.sum("product_count")).first()
    assert tuple(sums) == (1700, 3)


def test_category_without_scores(spark):
    df = products(spark, ("A", None, None, 1.0, 1.0, 1.0, 1.0, 1.0, 0.1, 1.0, 1.0))
    assert category_risk(df).count() == 0
    row = with_category_warnings(category_risk(df, scored_only=False)).first()
    assert row.risk_score is row.risk_level is None and row.product_count == 1
    assert "No valid product risk scores" in row.warning


def test_overall_health_of_nothing(spark):
    row = overall_health(products(spark).where("false")).first()
    assert (row.total_products, row.total_categories, row.overall_health_status) == (0, 0, None)
    assert "No category or product data" in row.warning
