"""From raw records to one row per product and day, and the filters on that table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.guards import staged, windowed
from shelfline.functions.planning import margin
from shelfline.schema import typed

LABELS = ["category", "supplier"]
MEASURES = ["inventory", "unit_cost", "selling_price", "lead_time_days"]


def _seq_where_known(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.col("seq"))


def _finished_days(records: DataFrame, labels: list[str]) -> DataFrame:
    """One row per product and day: summed units, and the last non-null value of the rest."""
    return records.groupBy("product", "date").agg(
        F.coalesce(F.sum("units_sold"), F.lit(0.0)).alias("units_sold"),
        *[F.max_by(name, _seq_where_known(name)).alias(name) for name in MEASURES + labels],
    )


def _rolled_up(records: DataFrame, labels: list[str], one_record_per_day: bool) -> DataFrame:
    """Finished days, clustered by product."""
    if one_record_per_day:
        return _finished_days(records.repartition("product"), labels)
    return _finished_days(records, labels).repartition("product")


def daily_table(raw: DataFrame, *, supplier: bool = True,
                one_record_per_day: bool = False) -> DataFrame:
    """Roll records up to product and day and derive revenue, profit, value and stock change.

    Raw rows are combined on the map side, shuffled by product *and* day and finished there, so a
    product that holds a large share of the records is spread over many tasks, and a day with many
    records (of many suppliers, say) sends one row from each task that reads it.  Only finished days
    are clustered by product: at most one row per calendar day, which bounds the group that one task
    sees.  That clustering and its order by date also serve every per-product window and aggregate
    applied to the result.

    ``supplier=False`` leaves the supplier out; nothing after the daily table uses it.
    ``one_record_per_day=True`` is a layout hint, not a change of result: for feeds that already
    hold one record per product and day it skips the first of the two shuffles.  On any other feed
    all records of a product then meet in one task.
    """
    records = typed(raw).where(F.col("product").isNotNull() & F.col("date").isNotNull())
    labels = LABELS if supplier else LABELS[:1]
    days = _rolled_up(records, labels, one_record_per_day)
    derived = staged(
        windowed(days, {"opening_inventory":
                        "lag(inventory) over (partition by product order by date)"}),
        {
            "daily_revenue": "units_sold * selling_price",
            "daily_profit": "units_sold * (selling_price - unit_cost)",
            "inventory_value": "inventory * unit_cost",
            "sales_velocity": "units_sold",
        },
        {
            "inventory_change": "inventory - opening_inventory",
            "profit_margin": f"coalesce({margin('daily_profit', 'daily_revenue')}, 0D)",
        },
    )
    return derived.select(
        "product", "date", *labels, "inventory", "units_sold", "unit_cost", "selling_price",
        "lead_time_days", "daily_revenue", "daily_profit", "inventory_value",
        "opening_inventory", "inventory_change", "sales_velocity", "profit_margin")


def matches(name: Column, search: str, literal: bool = False) -> Column:
    """Case-insensitive search; ``search`` is a regular expression unless ``literal``."""
    folded = F.lower(name)
    return folded.contains(search.lower()) if literal else folded.rlike(search.lower())


def filter_days(daily: DataFrame, start: date | str | None = None, end: date | str | None = None,
                categories: Sequence[str] = (), search: str = "", *,
                literal: bool = False) -> DataFrame:
    """Inclusive date range, category list and product search; an empty argument filters nothing.

    Filters apply to the finished daily table: ``opening_inventory`` may come from a day before
    ``start``, while statistics computed afterwards see only the rows kept here.
    """
    kept = daily.where(F.col("date").isNotNull())
    if start is not None:
        kept = kept.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        kept = kept.where(F.col("date") <= F.lit(end).cast("date"))
    if categories:
        kept = kept.where(F.col("category").isin(list(categories)))
    if search:
        kept = kept.where(matches(F.col("product"), search, literal))
    return kept


def date_bounds(df: DataFrame, default_days: int = 90) -> DataFrame:
    """One row with the first and last date; the last ``default_days`` days when there is none."""
    day = F.col("date").try_cast("date")
    today = F.current_date()
    return df.agg(
        F.coalesce(F.min(day), F.date_sub(today, default_days)).alias("min_date"),
        F.coalesce(F.max(day), today).alias("max_date"),
    )


def categories(df: DataFrame, label_missing: str | None = None) -> DataFrame:
    """Distinct category names, sorted; missing ones are dropped or shown as ``label_missing``."""
    name = F.col("category")
    if label_missing is not None:
        name = F.coalesce(name, F.lit(label_missing))
    return df.select(name.alias("category")).where("category is not null").distinct().orderBy("category")
