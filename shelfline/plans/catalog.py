"""Named queries: (session, folder of the tables) -> DataFrame with flat, rounded columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.flatten import flattened
from shelfline.functions.notes import product_warnings, with_financial_notes
from shelfline.functions.planning import Inputs, with_financial, with_planning
from shelfline.operators import daily as days
from shelfline.operators import demand, history, profile, quality, reports, rollup, scenario
from shelfline.params import DEFAULTS, Params
from shelfline.sources.feeds import read_csv, read_parquet
from shelfline.sources.star import daily_feed, untyped_feed
from shelfline.sources.store import new_folder, stored

Query = Callable[[SparkSession, str], DataFrame]

# The what-if grid of the catalog: five demand changes by four lead-time changes.
GRID = scenario.Grid(demand_percent=(-50, -20, 0, 20, 100), lead_days=(-5, 0, 3, 14))
# Scenarios one by one, with assumptions left out and with such as make no sense.
SINGLE = scenario.Scenarios([("none", None, None), ("demand", 0.1, None), ("lead", None, 3.0),
                             ("both", -0.25, 2.5), ("negative", -1.5, None), ("early", None, -100.0)])
LEVELS = (0.5, 0.8, 0.9, 0.95, 0.975, 0.99, 0.999, 1.0)
# Levels so low that categories and the whole are at risk.
STRICT = Params(low_risk_max=10.0, medium_risk_max=20.0)
ONE_PRODUCT = "P000007"
# Sums of money over many products are compared at the precision double addition leaves them.
MONEY_PLACES = 3
SUMS = {"inventory_value", "capital_tied_up", "stockout_exposure", "excess_inventory_value",
        "total_stockout_exposure", "total_excess_inventory_value", "total_capital_tied_up",
        "total_revenue_at_risk", "total_profit_at_risk"}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(name, places).alias(name) if kind == "double" else F.col(name)
                       for name, kind in df.dtypes])


def rolled_up(df: DataFrame) -> DataFrame:
    """Scores like all numbers, sums of money over products as MONEY_PLACES says."""
    return df.select(*[
        F.round(name, MONEY_PLACES if name in SUMS else 6).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes])


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return days.daily_table(daily_feed(spark, folder), supplier=False)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    return profile.product_profile(daily(spark, folder))


def stored_profiles(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The profile as a table, for queries that read it more than once."""
    wanted = profiles(spark, folder)
    return stored(wanted.select(*columns) if columns else wanted, "profile")


def _on_daily(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(operator(daily(spark, folder)))


def _on_profile(operator: Callable[[DataFrame], DataFrame],
                shown: Callable[[DataFrame], DataFrame] = rounded) -> Query:
    return lambda spark, folder: shown(operator(profiles(spark, folder)))


# --- input ------------------------------------------------------------------------------------
def validation_report(spark, folder):
    return quality.validation_report(daily_feed(spark, folder))


def validation_report_faulty(spark, folder):
    return quality.validation_report(untyped_feed(spark, folder))


def validation_report_blocked(spark, folder):
    return quality.validation_report(untyped_feed(spark, folder, bad_types=True))


def validation_missing_columns(spark, folder):
    return quality.validation_report(daily_feed(spark, folder).drop("supplier", "lead_time_days"))


def validation_verdict(spark, folder):
    return quality.verdict(validation_report(spark, folder))


def daily_processed(spark, folder):
    return rounded(days.daily_table(daily_feed(spark, folder)))


def daily_from_csv(spark, folder):
    """The daily table of the feed written as CSV files and read back, in the order of the files."""
    path = new_folder(spark, "feed")
    daily_feed(spark, folder).orderBy("seq").drop("seq").write.option("header", True).csv(path)
    return rounded(days.daily_table(read_csv(spark, path)))


def daily_from_parquet(spark, folder):
    """The same from parquet files, which number their rows."""
    path = new_folder(spark, "feed")
    daily_feed(spark, folder).orderBy("seq").drop("seq").write.parquet(path)
    return rounded(days.daily_table(read_parquet(spark, path)))


def filtered_daily(spark, folder):
    table = days.daily_table(daily_feed(spark, folder))
    return rounded(days.filter_days(table, "1994-01-01", "1996-12-31",
                                    ["PROMO", "SMALL", "LARGE"], "[13579]$"))


def date_bounds(spark, folder):
    return days.date_bounds(daily_feed(spark, folder))


def category_list(spark, folder):
    return days.categories(daily(spark, folder))


# --- demand -----------------------------------------------------------------------------------
def filtered_demand_stats(spark, folder):
    """Statistics over a filtered date range, as a dashboard selection would ask for them."""
    chosen = days.filter_days(daily(spark, folder), "1995-01-01", "1996-12-31")
    return rounded(demand.demand_statistics(chosen))


# --- planning, exposure -----------------------------------------------------------------------
def financial_with_sales(spark, folder):
    """Financial metrics with daily revenue, taking mean demand as the day's sales."""
    inputs = Inputs(sold="mean_demand")
    base = demand.demand_profile(daily(spark, folder)).select(
        "product", "mean_demand", "std_dev", *demand.STATE_COLUMNS)
    priced = with_financial(with_planning(base, inputs), inputs)
    return rounded(priced.select("product", "daily_revenue", "daily_cogs", "daily_profit",
                                 "profit_per_unit", "gross_margin"))


def reorder_report(spark, folder):
    """What to order, and why: the flagship report."""
    return rounded(profiles(spark, folder).select(
        "product", "category", "lead_time_demand", "safety_stock", "reorder_point",
        "days_remaining", "stockout_probability", "reorder_quantity", "risk_score", "risk_level",
        "action", "priority"))


def planning_by_service_level(spark, folder):
    """What each service level asks for, per product."""
    planned = profile.planning_by_level(profiles(spark, folder), LEVELS)
    return planned.select(*[
        F.round(name, 9 if name in ("z_score", "service_level") else 6).alias(name) if kind == "double"
        else name for name, kind in planned.dtypes])


def product_risk_with_reference(spark, folder):
    """Risk with revenue at risk measured against the largest of all products."""
    scored = profile.product_profile(daily(spark, folder), financial_reference=F.max("revenue_at_risk"))
    return rounded(scored.select("product", *profile.RISK_COLUMNS))


def planning_notes(spark, folder):
    """Warnings of planning and exposure without an assumed deviation, one product in ten given away."""
    inputs = Inputs(sold="mean_demand", price="price")
    base = demand.demand_profile(daily(spark, folder)).select(
        "product", "mean_demand", "std_dev", *demand.STATE_COLUMNS,
        F.when(~F.col("product").endswith("7"), F.col("selling_price")).otherwise(0.0).alias("price"))
    noted = with_financial_notes(with_financial(with_planning(base, inputs), inputs), inputs)
    return noted.select("product", F.posexplode("financial_warnings").alias("position", "warning"))


def risk_weights(spark, folder):
    """The weights in use per product, one row per available component."""
    return rounded(profile.product_risk(daily(spark, folder))
                   .select("product", F.explode("weights_used").alias("component", "weight")))


# --- recommendation ---------------------------------------------------------------------------
def _recommendations(df: DataFrame) -> DataFrame:
    return df.select("product", "category", "coverage_ratio", "excess_ratio", "branch", "action",
                     "priority", "suggested_quantity")


def _reasons(df: DataFrame) -> DataFrame:
    return df.select("product", F.posexplode("reason_codes").alias("position", "code"))


def _reason_texts(df: DataFrame) -> DataFrame:
    return df.select("product", F.posexplode("reasons").alias("position", "reason"))


def recommendation_evidence(spark, folder):
    found = profile.recommendations(daily(spark, folder))
    return flattened(found.select("product", "evidence"), "product")


def _gate_warnings(df: DataFrame) -> DataFrame:
    return df.select("product", F.posexplode("gate_warnings").alias("position", "warning"))


ENRICHED_SOURCE = ["product", "category", "mean_demand", "cv", "trend", "trend_strength",
                   "observation_count", "current_inventory", "selling_price", "lead_time_days",
                   *profile.PLANNING_COLUMNS, *profile.FINANCIAL_COLUMNS, "risk_score",
                   "risk_level"]


def _enriched(spark, folder, params: Params = DEFAULTS) -> DataFrame:
    wanted = profile.product_profile(daily(spark, folder), params).select(*ENRICHED_SOURCE)
    return reports.recommendations_in_context(stored(wanted, "profile"), params)


def recommendations_enriched(spark, folder):
    return rounded(_enriched(spark, folder).select(
        "product", "category", "action", "priority", "category_risk_level",
        "category_risk_score", "overall_health_status"))


def enriched_reasons(spark, folder):
    return _enriched(spark, folder).select(
        "product", F.posexplode("reason_codes").alias("position", "code"))


def enriched_reasons_strict(spark, folder):
    """Reasons where categories and the whole product set are at risk."""
    return _enriched(spark, folder, STRICT).select(
        "product", F.posexplode(F.arrays_zip("reason_codes", "reasons")).alias("position", "reason")).select(
        "product", "position", F.col("reason.reason_codes").alias("code"), F.col("reason.reasons").alias("reason"))


# --- nested records ---------------------------------------------------------------------------
def product_profile_nested(spark, folder):
    return flattened(profile.nested(profiles(spark, folder)), "product")


def product_detail(spark, folder):
    return flattened(profile.product_detail(profiles(spark, folder), ONE_PRODUCT), "product")


def product_context(spark, folder):
    return flattened(reports.product_record(profiles(spark, folder), ONE_PRODUCT))


# --- rankings and reports ---------------------------------------------------------------------
def top_priorities(spark, folder):
    return rounded(reports.top_priorities(profiles(spark, folder)).select(
        "position", "product", "category", "action", "priority", "risk_score", "risk_level",
        "suggested_quantity", "stockout_probability", "excess_units",
        F.array_join("reason_codes", ",").alias("reason_codes")))


def top_risk(spark, folder):
    return rounded(reports.top_risk(profiles(spark, folder)).select(
        "position", *reports.CONTEXT_COLUMNS, "recommendation_action", "recommendation_priority"))


def explorer_filtered(spark, folder):
    table = reports.product_explorer(profiles(spark, folder))
    found = reports.explore(table, "[02468]$", ["MEDIUM", "HIGH"], ["PROMO", "SMALL", "STANDARD"],
                            stockout=True, excess=False, sort_by="priority")
    return rounded(found)


def category_risk_of_total(spark, folder):
    """Category risk with the share of the total inventory value taken into account."""
    products = stored_profiles(spark, folder, [
        "product", "category", "risk_score", "risk_level", "inventory_value", "capital_tied_up",
        "shortage_units", "selling_price", "excess_inventory_value", "cv", "revenue_at_risk",
        "profit_at_risk"])
    total = products.where("risk_score is not null").agg(F.sum("inventory_value")).scalar()
    return rolled_up(rollup.category_risk(products, total))


def category_warnings(spark, folder):
    """Categories where no product has a score, which the feed's first category is made to be."""
    products = profiles(spark, folder).withColumn(
        "risk_score", F.when(F.col("category") != "PROMO", F.col("risk_score")))
    found = rollup.with_category_warnings(rollup.category_risk(products, scored_only=False))
    return found.select("category", "product_count", "risk_level", "warning")


def overall_health_empty(spark, folder):
    return rollup.overall_health(profiles(spark, folder).where("false"))


def brief_context(spark, folder):
    """Everything a brief may mention; sums over products at the precision that addition leaves them."""
    sections = reports.brief_records(stored_profiles(spark, folder))
    return reduce(DataFrame.unionByName, [
        flattened(rows.select("section", "position", "key", "record.*") if section != "product" else
                  rows.select("section", "position", "key", rows["record"].dropFields("position").alias("record"))
                  .select("section", "position", "key", "record.*"),
                  "section", "position", "key", places=MONEY_PLACES if section == "overall" else 6)
        for section, rows in zip(("overall", "category", "product"), sections, strict=True)])


def scenario_results(spark, folder):
    table = scenario.scenario_results(profiles(spark, folder), GRID)
    return rounded(table.drop(*[c for c in table.columns if c.startswith("delta_")], "direction"))


def scenario_deltas(spark, folder):
    table = scenario.scenario_results(profiles(spark, folder), GRID)
    return rounded(table.select("product", "scenario_id", "scenario_error", "direction",
                                *[c for c in table.columns if c.startswith("delta_")]))


def scenario_single(spark, folder):
    """Scenarios of which some leave an assumption out."""
    return rounded(scenario.scenario_results(profiles(spark, folder), SINGLE))


def queries() -> dict[str, Query]:
    return {
        "reorder_report": reorder_report,
        "validation_report": validation_report,
        "validation_report_faulty": validation_report_faulty,
        "validation_report_blocked": validation_report_blocked,
        "validation_missing_columns": validation_missing_columns,
        "validation_verdict": validation_verdict,
        "daily_processed": daily_processed,
        "daily_from_csv": daily_from_csv,
        "daily_from_parquet": daily_from_parquet,
        "filtered_daily": filtered_daily,
        "date_bounds": date_bounds,
        "category_list": category_list,
        "demand_stats": _on_daily(demand.demand_statistics),
        "filtered_demand_stats": filtered_demand_stats,
        "demand_trend": _on_daily(demand.demand_trend),
        "outlier_bounds": _on_daily(demand.outlier_bounds),
        "outlier_rows": _on_daily(demand.outlier_rows),
        "weekday_factors": _on_daily(demand.weekday_factors),
        "monthly_factors": _on_daily(demand.monthly_factors),
        "seasonality_summary": _on_daily(demand.seasonality),
        "inventory_planning": _on_daily(profile.inventory_planning),
        "planning_by_service_level": planning_by_service_level,
        "planning_notes": planning_notes,
        "financial_metrics": _on_daily(profile.financial_metrics),
        "financial_with_sales": financial_with_sales,
        "product_risk": _on_profile(lambda df: df.select("product", *profile.RISK_COLUMNS)),
        "product_risk_with_reference": product_risk_with_reference,
        "risk_weights": risk_weights,
        "recommendations": _on_profile(_recommendations),
        "recommendation_reasons": _on_profile(_reasons),
        "recommendation_reason_texts": _on_profile(_reason_texts),
        "recommendation_evidence": recommendation_evidence,
        "recommendation_warnings": _on_profile(_gate_warnings),
        "recommendations_enriched": recommendations_enriched,
        "enriched_reasons": enriched_reasons,
        "enriched_reasons_strict": enriched_reasons_strict,
        "product_warnings": _on_profile(product_warnings),
        "product_profile_nested": product_profile_nested,
        "product_detail": product_detail,
        "product_context": product_context,
        "top_priorities": top_priorities,
        "top_risk": top_risk,
        "product_explorer": _on_profile(reports.product_explorer),
        "explorer_filtered": explorer_filtered,
        "category_risk": _on_profile(rollup.category_risk, rolled_up),
        "category_risk_of_total": category_risk_of_total,
        "category_comparison": _on_profile(
            lambda df: reports.comparable_categories(rollup.category_risk(df)), rolled_up),
        "category_warnings": category_warnings,
        "overall_health": _on_profile(rollup.overall_health, rolled_up),
        "overall_health_empty": overall_health_empty,
        "demand_history": _on_daily(history.demand_history),
        "inventory_history": _on_daily(history.inventory_history),
        "history_products": _on_profile(history.history_products),
        "inventory_events": _on_daily(history.inventory_events),
        "scenario_results": scenario_results,
        "scenario_deltas": scenario_deltas,
        "scenario_single": scenario_single,
        "brief_context": brief_context,
    }
