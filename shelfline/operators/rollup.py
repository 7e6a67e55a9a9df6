"""Product risk rolled up to categories and to one overall health record.

Both reports come from the same category aggregate.  It combines on the map side, so a category
that holds a large share of the products costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline import messages
from shelfline.functions.guards import band
from shelfline.functions.risk import risk_level
from shelfline.params import DEFAULTS, Params

CATEGORY_COLUMNS = ["category", "product_count", "high_risk_product_count",
                    "average_product_risk_score", "inventory_value", "capital_tied_up",
                    "stockout_exposure", "excess_inventory_value", "demand_volatility",
                    "value_score", "high_risk_score", "risk_score", "risk_level"]


def _by_category(products: DataFrame, scored_only: bool) -> DataFrame:
    """Sums per category, the missing category included, over all products in one pass.

    Category measures use the products that take part in the category report; the fields named
    ``all_*`` use every product, for the overall record.
    """
    part = F.col("risk_score").isNotNull() if scored_only else F.lit(True)

    def of_part(value: Column) -> Column:
        return F.when(part, value)

    level = F.col("risk_level")
    return products.groupBy("category").agg(
        F.count_if(part).alias("product_count"),
        F.count_if(part & (level == "HIGH")).alias("high_risk_product_count"),
        F.avg("risk_score").alias("average_product_risk_score"),
        F.avg(of_part(F.col("cv"))).alias("demand_volatility"),
        F.sum(of_part(F.col("inventory_value"))).alias("inventory_value"),
        F.sum(of_part(F.col("capital_tied_up"))).alias("capital_tied_up"),
        F.sum(of_part(F.col("shortage_units") * F.col("selling_price"))).alias("stockout_exposure"),
        F.sum(of_part(F.col("excess_inventory_value"))).alias("excess_inventory_value"),
        F.count(F.lit(1)).alias("all_products"),
        F.count_if(level.isin("MEDIUM", "HIGH")).alias("all_at_risk"),
        F.sum("revenue_at_risk").alias("all_revenue_at_risk"),
        F.sum("profit_at_risk").alias("all_profit_at_risk"),
    )


def _scored(groups: DataFrame, total_inventory_value: Column | float | None,
            params: Params) -> DataFrame:
    """Category score: average product risk, share of inventory value, share of HIGH products."""
    total = (F.lit(total_inventory_value).cast("double")
             if total_inventory_value is None or isinstance(total_inventory_value, (int, float))
             else total_inventory_value)
    listed = F.col("category").isNotNull() & (F.col("product_count") > 0)
    share = F.when(total > 0, F.col("inventory_value") / total * 100)
    high = F.col("high_risk_product_count") / F.col("product_count")
    mix = (params.category_average_weight * F.col("average_product_risk_score")
           + params.category_value_weight * F.col("value_score")
           + params.category_high_risk_weight * F.col("high_risk_score"))
    return (
        groups.withColumns({
            "listed": listed,
            "value_score": F.when(listed, F.least(F.coalesce(share, F.lit(0.0)), F.lit(100.0))),
            "high_risk_score": F.when(listed, F.least(high * 200, F.lit(100.0))),
        })
        .withColumn("risk_score", F.when(listed & mix.isNotNull(),
                                         F.greatest(F.least(mix, F.lit(100.0)), F.lit(0.0))))
        .withColumn("risk_level", F.expr(risk_level("risk_score", params)))
    )


def category_risk(products: DataFrame, total_inventory_value: Column | float | None = None,
                  params: Params = DEFAULTS, *, scored_only: bool = True) -> DataFrame:
    """One row per category.  ``scored_only`` leaves out products without a risk score."""
    return (_scored(_by_category(products, scored_only), total_inventory_value, params)
            .where("listed").select(*CATEGORY_COLUMNS))


def with_category_warnings(categories: DataFrame) -> DataFrame:
    before, after = messages.NO_CATEGORY_SCORES.split("{}")
    text = F.concat(F.lit(before), F.col("category"), F.lit(after))
    return categories.withColumn(
        "warning", F.when(F.col("average_product_risk_score").isNull(), text))


def overall_health(products: DataFrame, total_inventory_value: Column | float | None = None,
                   params: Params = DEFAULTS, *, scored_only: bool = True) -> DataFrame:
    """One row for the whole product set, also when it is empty."""
    groups = _scored(_by_category(products, scored_only), total_inventory_value, params)

    def positive_sum(name: str) -> Column:
        return F.sum(F.when(F.col("listed") & (F.col(name) > 0), F.col(name)))

    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name)).alias(f"total_{name}")

    def count(value: Column) -> Column:
        return F.coalesce(value, F.lit(0)).cast("long")

    totals = groups.agg(
        F.avg("risk_score").alias("overall_risk_score"),
        count(F.sum("all_products")).alias("total_products"),
        count(F.sum("all_at_risk")).alias("products_at_risk"),
        F.count_if("listed").alias("total_categories"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_categories"),
        positive_sum("stockout_exposure").alias("total_stockout_exposure"),
        positive_sum("excess_inventory_value").alias("total_excess_inventory_value"),
        positive_sum("capital_tied_up").alias("total_capital_tied_up"),
        F.sum("all_revenue_at_risk").alias("revenue_at_risk"),
        F.sum("all_profit_at_risk").alias("profit_at_risk"),
    )
    status = F.expr(band("overall_risk_score", params.low_risk_max, params.medium_risk_max,
                         ("HEALTHY", "ATTENTION", "CRITICAL")))
    return totals.select(
        "overall_risk_score", status.alias("overall_health_status"), "total_products",
        "products_at_risk", "total_categories", "high_risk_categories",
        "total_stockout_exposure", "total_excess_inventory_value", "total_capital_tied_up",
        positive("revenue_at_risk"), positive("profit_at_risk"),
        F.when(F.col("total_products") == 0, messages.NO_DATA_FOR_HEALTH).alias("warning"),
    )
