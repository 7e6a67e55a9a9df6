"""The daily feed as a view over an order star schema (lineitem, part, supplier).

The joins carry no hints: small dimensions are broadcast when their measured size allows it, large
ones are shuffled, and adaptive execution splits skewed join keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_feed(spark: SparkSession, folder: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    sold = table("lineitem")
    feed = (sold.join(table("part"), sold.l_partkey == F.col("p_partkey"))
            .join(table("supplier"), sold.l_suppkey == F.col("s_suppkey")))
    part, order, year = F.col("p_partkey"), F.col("l_orderkey"), F.year("l_shipdate")
    quantity = F.col("l_quantity")
    units = (
        F.when(part % 50 == 0, 0.0)
        .when(part % 11 == 0, F.when(order % 10 == 0, quantity * 10).otherwise(0.0))
        .when(part % 7 == 1, quantity * (year - 1994))
        .when(part % 7 == 2, quantity * (2002 - year))
        .when(part % 13 == 3, 10.0)
        .otherwise(quantity)
    )
    stock = (F.col("l_partkey") * 7919 + order * 31 + F.col("l_linenumber") * 17) % 1600
    lead = F.when(part % 17 == 5, 60).when(part % 17 == 9, 45).otherwise(1 + part % 14)
    return feed.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("P"), F.lpad(part.cast("string"), 6, "0")).alias("product"),
        F.col("p_type").alias("category"),
        F.when(order % 23 != 0, stock.cast("double")).alias("inventory"),
        units.cast("double").alias("units_sold"),
        (F.col("p_retailprice") * 0.5).alias("unit_cost"),
        F.col("p_retailprice").alias("selling_price"),
        F.col("s_name").alias("supplier"),
        lead.cast("double").alias("lead_time_days"),
        (order * 10 + F.col("l_linenumber")).alias("seq"),
    )


def untyped_feed(spark: SparkSession, folder: str, *, bad_types: bool = False) -> DataFrame:
    """The feed as text with faults at fixed places, as a carelessly exported CSV would hold it."""
    feed = daily_feed(spark, folder)
    seq = F.col("seq")

    def spoil(name: str, period: int, text: str | None) -> None:
        nonlocal feed
        feed = feed.withColumn(name, F.when(seq % period == 0, F.lit(text))
                               .otherwise(F.col(name).cast("string")))

    spoil("units_sold", 997, "-5")
    spoil("lead_time_days", 991, "0")
    spoil("category", 983, None)
    spoil("unit_cost", 977, None)
    spoil("selling_price", 971, "-1.5")
    if bad_types:
        spoil("date", 967, "not-a-date")
        spoil("inventory", 953, "not-a-number")
    return feed
