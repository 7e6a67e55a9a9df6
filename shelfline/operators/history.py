"""Per-day history of products and the events found in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.guards import number, windowed
from shelfline.operators.demand import WHOLE, annotate
from shelfline.params import DEFAULTS, Params


def demand_history(daily: DataFrame) -> DataFrame:
    return daily.select("product", "date",
                        F.coalesce("units_sold", F.lit(0.0)).alias("units_sold"))


def inventory_history(daily: DataFrame) -> DataFrame:
    return daily.select("product", "date", "inventory")


def inventory_events(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(product, date, event_type, value): spikes, stockouts, replenishments, low safety stock.

    Safety stock is worked out with windows on the rows at hand instead of being joined from the
    profile, so the whole operator needs the clustering by product only.
    """
    rows = annotate(daily.withColumn("units_sold", F.coalesce("units_sold", F.lit(0.0))), params)
    z = number(params.z_score)
    rows = windowed(
        rows,
        {
            "previous": "coalesce(lag(inventory) over (partition by product order by date), 0D)",
            "sd": f"coalesce(stddev_samp(units_sold) over {WHOLE}, 0D)",
            "lead": f"last(lead_time_days) over {WHOLE}",
        },
        {"safety_stock": f"case when lead > 0 then {z} * (sd * sqrt(lead)) end"},
    )
    found = {
        "DEMAND_SPIKE": ("is_outlier", "units_sold"),
        "STOCKOUT": ("inventory = 0", "inventory"),
        "REPLENISHMENT": (f"inventory > previous * {number(params.replenishment_factor)}",
                          "inventory"),
        "SAFETY_STOCK_BREACH": ("inventory < safety_stock", "inventory"),
    }
    events = ", ".join(f"if({condition}, named_struct('event_type', '{name}', 'value', {value}), null)"
                       for name, (condition, value) in found.items())
    return (rows.select("product", "date", F.expr(f"explode(array({events}))").alias("event"))
            .where("event is not null")
            .select("product", "date", "event.event_type", "event.value"))


def history_products(profile: DataFrame, categories: Sequence[str] = (),
                     products: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The products a history view may show: those named, else all, or the first `limit` by name."""
    label = F.coalesce("category", F.lit("Uncategorized"))
    listed = profile.select("product", label.alias("category"))
    if categories:
        listed = listed.where(F.col("category").isin(list(categories)))
    if products:
        return listed.where(F.col("product").isin(list(products)))
    return listed if limit is None else listed.orderBy("product").limit(limit)
