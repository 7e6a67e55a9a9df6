from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from daily_rows import DAILY  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("shelfline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Daily rows from lists of demand: {product: [values]} starting on a given day."""
    def build(products: dict[str, list], start=date(2024, 1, 1), inventory=60.0, lead=7.0,
              cost=5.0, price=10.0, category="A"):
        rows = [(p, start + timedelta(days=i), category, inventory,
                 None if v is None else float(v), cost, price, lead)
                for p, values in products.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, DAILY)
    return build


@pytest.fixture(scope="session")
def by_product():
    """Collected rows keyed by product."""
    return lambda df: {row.product: row.asDict(recursive=True) for row in df.collect()}
