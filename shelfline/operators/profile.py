"""The product profile: every per-product result in one row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import notes
from shelfline.functions.guards import number, staged
from shelfline.functions.planning import Inputs, with_financial, with_planning
from shelfline.functions.recommend import evidence, with_recommendation
from shelfline.functions.risk import (COMPONENTS, Signals, weights_used, with_risk_level,
                                      with_scores)
from shelfline.operators.demand import (DEMAND_COLUMNS, OUTLIER_COLUMNS, PATTERN_COLUMNS,
                                        STATE_COLUMNS, TREND_COLUMNS,
                                        profile_numbers, with_factor_maps, with_labels)
from shelfline.params import DEFAULTS, Params
from shelfline.sources.store import stored

PLANNING_COLUMNS = ["lead_time_demand", "lead_time_sd", "safety_stock", "reorder_point",
                    "days_remaining", "stockout_probability", "reorder_quantity"]
FINANCIAL_COLUMNS = ["profit_per_unit", "inventory_value", "capital_tied_up", "shortage_units",
                     "revenue_at_risk", "profit_at_risk", "target_stock", "excess_units",
                     "excess_inventory_value"]
RISK_COLUMNS = [f"{name}_score" for name in COMPONENTS] + ["available_weight_sum", "risk_score",
                                                           "risk_level"]
RECOMMENDATION_COLUMNS = ["coverage_ratio", "excess_ratio", "branch", "action", "priority",
                          "suggested_quantity", "reason_codes", "reasons"]

# Without history there is no spread to plan with: a single observation is planned as certain.
PLANNED = Inputs(mean="planning_mean", sd="planning_sd", cost="planning_cost", price="planning_price")


def with_planning_inputs(profile: DataFrame) -> DataFrame:
    """Mean, deviation, cost and price with "unknown" read as zero, as planning wants them."""
    return staged(profile, {
        "planning_mean": "coalesce(mean_demand, 0D)",
        "planning_sd": "coalesce(std_dev, 0D)",
        "planning_cost": "coalesce(unit_cost, 0D)",
        "planning_price": "coalesce(selling_price, 0D)",
    })


def product_profile(daily: DataFrame, params: Params = DEFAULTS,
                    financial_reference: float | Column | None = None) -> DataFrame:
    """Statistics, planning, exposure, risk and recommendation per product.

    ``financial_reference`` is what revenue at risk is compared with: a number, or an aggregate over
    the whole product set such as ``F.max("revenue_at_risk")``.  For an aggregate the numbers of all
    products are stored once and read twice, instead of being worked out twice.
    """
    planned = with_planning_inputs(profile_numbers(daily, params))
    planned = with_financial(with_planning(planned, PLANNED, params), PLANNED, params)
    signals = Signals()
    if isinstance(financial_reference, Column):
        planned = stored(planned, "planned")
        planned = planned.withColumn("financial_reference", planned.agg(financial_reference).scalar())
        signals = Signals(financial_reference="financial_reference")
    elif financial_reference is not None:
        signals = Signals(financial_reference=number(financial_reference))
    scored = with_scores(planned, signals, params=params).drop(
        "planning_mean", "planning_sd", "planning_cost", "planning_price", "financial_reference")
    labelled = with_labels(with_risk_level(settled(scored), params), params)
    return with_factor_maps(with_recommendation(labelled, params=params))


def settled(scored: DataFrame) -> DataFrame:
    """The same rows behind an aggregate on their key.

    Formulas that build on each other are a chain of projections.  A filter on a derived column
    would be rewritten in terms of the columns at the bottom of that chain, and its size multiplies
    at every step; here that stops at the numbers below.  Filters on the product still pass through
    to the scan and unused columns are still pruned.  The few texts are grouping keys, so the
    aggregate hashes; the rows are clustered by product already, so nothing is shuffled.
    """
    kinds = dict(scored.dtypes)
    keys = [name for name, kind in kinds.items() if kind == "string"]
    return scored.groupBy(*keys).agg(*[F.max(name).alias(name) for name in kinds if name not in keys])


def inventory_planning(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return product_profile(daily, params).select("product", *PLANNING_COLUMNS)


def planning_by_level(profile: DataFrame, levels: Sequence[float], params: Params = DEFAULTS) -> DataFrame:
    """Planning of every product at every service level; rows are expanded in place.

    A level that is not between 0 and 1 keeps its rows, without safety stock and what follows from it.
    """
    start = with_planning_inputs(profile).select(
        "product", "planning_mean", "planning_sd", "current_inventory", "lead_time_days",
        F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("service_level"))
    planned = with_planning(start, replace(PLANNED, level="service_level"), params)
    return planned.select("product", "service_level", "z_score", *PLANNING_COLUMNS)


def financial_metrics(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return product_profile(daily, params).select("product", *FINANCIAL_COLUMNS)


def product_risk(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return (product_profile(daily, params)
            .withColumn("weights_used", F.expr(weights_used(params)))
            .select("product", *RISK_COLUMNS, "weights_used"))


def recommendations(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return (product_profile(daily, params)
            .withColumn("evidence", F.expr(evidence()))
            .select("product", "category", *RECOMMENDATION_COLUMNS, "evidence", "gate_warnings"))


def nested(profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The profile as one struct per topic, for single-product views and exports."""
    full = notes.with_notes(profile, params).withColumn("weights_used", F.expr(weights_used(params)))

    def group(name: str, columns: list[str]) -> Column:
        return F.struct(*columns).alias(name)

    return full.select(
        "product", *STATE_COLUMNS,
        group("demand", [*DEMAND_COLUMNS, "demand_warnings"]),
        group("trend_result", [*TREND_COLUMNS, "trend_warnings"]),
        group("outliers", [*OUTLIER_COLUMNS, "outlier_warnings"]),
        group("pattern", ["mean_demand", "weekday_factors", "monthly_factors", *PATTERN_COLUMNS,
                          "pattern_warnings"]),
        group("planning", [*PLANNING_COLUMNS, "planning_warnings"]),
        group("financial", [*FINANCIAL_COLUMNS, "financial_warnings"]),
        group("risk", [*RISK_COLUMNS, "weights_used", "risk_warnings"]),
        F.struct(*RECOMMENDATION_COLUMNS, F.expr(evidence()).alias("evidence"),
                 "gate_warnings").alias("recommendation"),
    )


def product_detail(profile: DataFrame, product: str, params: Params = DEFAULTS) -> DataFrame:
    """One product with all its results; the filter reaches the scan through the grouping key."""
    return nested(profile.where(F.col("product") == product), params)
