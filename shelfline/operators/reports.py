"""Rankings, the explorer table, and the records a business brief is written from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.recommend import Context, evidence, priority_rank, with_recommendation
from shelfline.operators.daily import matches
from shelfline.operators.rollup import category_risk, overall_health
from shelfline.params import DEFAULTS, Params

CONTEXT_COLUMNS = ["product", "category", "mean_demand", "cv", "trend", "trend_strength",
                   "current_inventory", "days_remaining", "lead_time_days", "safety_stock",
                   "reorder_point", "reorder_quantity", "stockout_probability", "excess_units",
                   "excess_inventory_value", "revenue_at_risk", "profit_at_risk", "risk_score",
                   "risk_level"]


def _score() -> Column:
    return F.coalesce("risk_score", F.lit(0.0))


def _numbered(top: DataFrame, order: list[Column]) -> DataFrame:
    """Position within an already limited set; the window sees at most k rows."""
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def top_priorities(profile: DataFrame, params: Params = DEFAULTS, k: int | None = None,
                   reasons: int | None = None) -> DataFrame:
    """The k most urgent products that have a recommendation, with all their reasons or the leading ones.

    k is meant for a page of results: positions are numbered in one task.
    """
    order = [F.expr(priority_rank("priority")), _score().desc(), F.col("product")]
    top = (profile.where(F.col("action") != "UNAVAILABLE")
           .orderBy(*order).limit(params.top_k if k is None else k))

    def leading(name: str) -> Column:
        return F.col(name) if reasons is None else F.slice(name, 1, reasons).alias(name)

    return _numbered(top, order).select(
        "position", "product", "category", "action", "priority", "risk_score", "risk_level",
        "suggested_quantity", "stockout_probability", "excess_units",
        leading("reason_codes"), leading("reasons"))


def top_risk(profile: DataFrame, params: Params = DEFAULTS, k: int | None = None) -> DataFrame:
    """The k riskiest products with the fields of a product context."""
    order = [_score().desc(), F.col("product")]
    top = profile.orderBy(*order).limit(params.top_k if k is None else k)
    return _numbered(top, order).select("position", *_context())


def _context() -> list[Column | str]:
    return [*CONTEXT_COLUMNS, F.col("action").alias("recommendation_action"),
            F.col("priority").alias("recommendation_priority"),
            F.col("reasons").alias("recommendation_reasons"),
            F.expr(evidence()).alias("recommendation_evidence")]


def product_explorer(profile: DataFrame) -> DataFrame:
    """One display row per product."""
    issue = (F.when(F.col("action") == "REORDER", "Stockout risk")
             .when(F.col("action") == "REDUCE", "Excess inventory")
             .when(F.col("action") == "HOLD", "Low demand")
             .when(F.col("action") == "MONITOR", "Volatility / trend")
             .otherwise("Healthy"))
    return profile.select(
        "product", F.coalesce("category", F.lit("N/A")).alias("category"),
        _score().alias("risk_score"), F.coalesce("risk_level", F.lit("N/A")).alias("risk_level"),
        "action", "priority", issue.alias("main_issue"), "stockout_probability", "excess_units",
        "excess_ratio")


def explore(explorer: DataFrame, search: str = "", risk_levels: Sequence[str] = (),
            categories: Sequence[str] = (), stockout: bool | None = None,
            excess: bool | None = None, sort_by: str = "risk", *,
            literal: bool = False) -> DataFrame:
    """Filter and sort the explorer table; ``None`` or an empty argument filters nothing."""
    found = explorer
    if search:
        found = found.where(matches(F.col("product"), search, literal))
    if risk_levels:
        found = found.where(F.col("risk_level").isin(list(risk_levels)))
    if categories:
        found = found.where(F.col("category").isin(list(categories)))
    for wanted, label in ((stockout, "Stockout risk"), (excess, "Excess inventory")):
        if wanted is not None:
            hit = F.col("main_issue") == label
            found = found.where(hit if wanted else ~hit)
    orders = {
        "risk": [F.desc("risk_score"), F.col("product")],
        "product": [F.col("product")],
        "priority": [F.expr(priority_rank("priority")), F.desc("risk_score"), F.col("product")],
    }
    return found.orderBy(*orders[sort_by])


def comparable_categories(categories: DataFrame) -> DataFrame:
    """Categories with a score, as the comparison chart shows them."""
    return (categories.where(F.col("risk_score").isNotNull())
            .select("category", "risk_score", "high_risk_product_count"))


def recommendations_in_context(profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Recommendations enriched with the risk of the category and the overall status.

    ``profile`` is read for the category report, for the overall record and for the products:
    pass a stored one (see `shelfline.sources.store`).  The join carries no hint; the category
    table is broadcast only when its measured size allows it.
    """
    levels = category_risk(profile, params=params).select(
        "category", F.col("risk_level").alias("category_risk_level"),
        F.col("risk_score").alias("category_risk_score"),
        F.col("stockout_exposure").alias("category_stockout_exposure"),
        F.col("excess_inventory_value").alias("category_excess_inventory_value"))
    status = overall_health(profile, params=params).select("overall_health_status").scalar()
    base = profile.drop("coverage_ratio", "excess_ratio", "branch", "action", "priority",
                        "suggested_quantity", "reason_codes", "reasons", "gate_warnings")
    joined = base.join(levels, "category", "left").withColumn("overall_health_status", status)
    context = Context(category="category", category_level="category_risk_level",
                      overall_status="overall_health_status")
    wider = ("category_risk_level", "category_risk_score", "category_stockout_exposure",
             "category_excess_inventory_value", "overall_health_status")
    return with_recommendation(joined, context, params).select(
        "product", "category", "branch", "action", "priority", "suggested_quantity",
        "reason_codes", "reasons", *wider,
        F.expr(evidence(context, wider)).alias("evidence"))


def brief_records(profile: DataFrame, params: Params = DEFAULTS) -> list[DataFrame]:
    """Rows (section, position, key, record) that hold everything a brief may mention, by section.

    One overall row, one row per category with its level, and the riskiest products.
    """
    def rows(df: DataFrame, section: str, key: Column, position: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), position.cast("int").alias("position"),
                         key.alias("key"), F.struct(*df.columns).alias("record"))

    none = F.lit(None).cast("string")
    levels = category_risk(profile, params=params).where("risk_level is not null")
    return [
        rows(overall_health(profile, params=params).drop("warning"), "overall", none, F.lit(1)),
        rows(levels.select("category", "risk_level"), "category", F.col("category"), F.lit(None)),
        rows(top_risk(profile, params), "product", F.col("product"), F.col("position")),
    ]


def brief_context(profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """`brief_records` with JSON payloads; they stay rows so that no task has to hold all categories."""
    payload = F.to_json("record").alias("payload")
    return reduce(DataFrame.unionByName, [rows.select("section", "position", "key", payload)
                                          for rows in brief_records(profile, params)])


def product_record(profile: DataFrame, product: str) -> DataFrame:
    """The context record of one product."""
    return profile.where(F.col("product") == product).select(*_context())


def product_context(profile: DataFrame, product: str) -> DataFrame:
    """The context record of one product as JSON."""
    one = product_record(profile, product)
    return one.select("product", F.to_json(F.struct(*one.columns)).alias("payload"))
