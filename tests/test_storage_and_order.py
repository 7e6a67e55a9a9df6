"""Where records come from and in which order, and how long stored tables last."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shelfline.operators import daily as days
from shelfline.plans import catalog
from shelfline.schema import POSITION, REQUIRED_COLUMNS, file_order, typed
from shelfline.sources import store
from shelfline.sources.feeds import read_csv, read_parquet, read_table

FOLDER = "/root/testdata/sf0.001"
HEADER = ",".join(REQUIRED_COLUMNS)


def split_small(spark, size: str):
    """Files cut into pieces of this size."""
    class Setting:
        names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                 "spark.sql.files.minPartitionNum")

        def __enter__(self):
            self.before = {n: spark.conf.get(n, None) for n in self.names}
            spark.conf.set(self.names[0], size)
            spark.conf.set(self.names[1], "1")
            spark.conf.set(self.names[2], "1")

        def __exit__(self, *_):
            for n, value in self.before.items():
                spark.conf.unset(n) if value is None else spark.conf.set(n, value)
    return Setting()


@pytest.mark.parametrize("body, rows", [
    ("1,2,3\n4,5,6\n", [("1", "2", "3"), ("4", "5", "6")]),
    ("1,2,3\n4,5\n6\n", [("1", "2", "3"), ("4", "5", None), ("6", None, None)]),
    ("1,,\n,2,3\n", [("1", None, None), (None, "2", "3")]),
    ('"1,2","3\n4",5\n', [("1,2", "3\n4", "5")]),
    ('"a ""b"", c",2\n', [('a "b", c', "2", None)]),
])
def test_records_up_to_the_header(spark, tmp_path, body, rows):
    (tmp_path / "x.csv").write_text("a,b,c\n" + body)
    assert [tuple(r)[:3] for r in read_csv(spark, str(tmp_path), multi_line=True).collect()] == rows


@pytest.mark.parametrize("record", ["4,5,6,x", "4,5,6,,x", "4,5,6,", "4,5,,,x", ",,,,", '4,"5,6",7,8', "4,5,6,,,,,x"])
def test_surplus_fields_are_an_error(spark, tmp_path, record):
    (tmp_path / "x.csv").write_text(f"a,b,c\n1,2,3\n{record}\n")
    with pytest.raises(Exception, match="more fields than its header"):
        read_csv(spark, str(tmp_path)).collect()


def test_a_file_with_a_column_called_seq(spark, tmp_path):
    (tmp_path / "x.csv").write_text(f"seq,{HEADER}\n9,2024-01-01,p,A,1,1,5,10,s,7\n10,2024-01-01,p,B,2,1,5,10,s,7\n"
                                    "8,2024-01-01,p,C,3,1,5,10,s,7\n")
    feed = read_csv(spark, str(tmp_path))
    assert feed.columns.count("seq") == 1 and [r.seq for r in feed.select("seq").collect()] == ["9", "10", "8"]
    assert days.daily_table(feed).first().category == "C"  # text does not order, the file does


def plain_last(records) -> dict:
    """The last inventory of each product and day, in the order given."""
    return {(r[1], r[0]): r[3] for r in records if r[3] is not None}


def test_parquet_order_does_not_depend_on_the_split(spark, tmp_path):
    """Three files of several row groups, read in one piece, in many and in pieces packed together."""
    import random

    rng = random.Random(3)
    records = []
    for n in range(3):
        some = [("2024-01-0" + str(rng.randint(1, 9)), f"p{rng.randint(0, 5)}", "A", rng.choice([None, rng.random()]), 1.0, 5.0, 10.0,
                 "s", 7.0) for _ in range(4000)]
        records += some
        frame = spark.createDataFrame(some, ", ".join(
            f"{c} {'double' if isinstance(v, float) or c == 'inventory' else 'string'}" for c, v in zip(REQUIRED_COLUMNS, some[0])))
        frame.coalesce(1).write.option("parquet.block.size", "4096").parquet(str(tmp_path / f"part-{n}"))
        name = next(f for f in os.listdir(tmp_path / f"part-{n}") if f.endswith(".parquet"))
        os.link(tmp_path / f"part-{n}" / name, tmp_path / f"file-{n}.parquet")
    expected = plain_last(records)
    tasks = set()
    for size in ("128m", "3000", "40000"):
        with split_small(spark, size):
            for feed in (spark.read.parquet(str(tmp_path / "file-*.parquet")), read_parquet(spark, str(tmp_path / "file-*.parquet")),
                         spark.read.parquet(str(tmp_path / "file-*.parquet")).filter("units_sold > 0").select(*REQUIRED_COLUMNS)):
                tasks.add(feed.rdd.getNumPartitions())
                found = days.daily_table(feed).where("inventory is not null").collect()
                assert {(r["product"], str(r.date)): r.inventory for r in found} == expected
    assert len(tasks) > 1


def test_rows_from_no_file_keep_their_place(spark):
    frame = spark.range(4).select(F.lit("2024-01-01").alias("date"), F.lit("p").alias("product"), F.lit("c").alias("category"),
                                  F.col("id").cast("double").alias("inventory"), *[F.lit(1.0).alias(n) for n in REQUIRED_COLUMNS[4:7]],
                                  F.lit("s").alias("supplier"), F.lit(1.0).alias("lead_time_days"))
    assert POSITION not in frame.columns and typed(frame).columns == [*REQUIRED_COLUMNS, "seq"]
    assert days.daily_table(frame).first().inventory == 3.0


def test_tables_have_positions_and_views_have_not(spark, tmp_path):
    frame = spark.createDataFrame([("2024-01-01", 1.0)], "date string, inventory double")
    frame.write.option("path", str(tmp_path / "t")).saveAsTable("stock_of_test")
    try:
        assert POSITION in read_table(spark, "stock_of_test").columns
        spark.table("stock_of_test").createOrReplaceTempView("stock_view")
        assert read_table(spark, "stock_view").columns == ["date", "inventory"]
    finally:
        spark.sql("drop table stock_of_test")


def files(folder: str) -> list[str]:
    return [f"{d}/{f}" for d, _, names in os.walk(folder) for f in names]


def test_nothing_stays_after_a_lifetime(spark):
    root = store.shared_folder(spark).removeprefix("file:")
    before = set(files(root))
    with store.lifetime(spark):
        for name in ("recommendations_enriched", "enriched_reasons", "category_risk_of_total", "brief_context", "product_risk_with_reference"):
            assert catalog.queries()[name](spark, FOLDER).count() > 0
        assert set(files(root)) - before
        with store.lifetime(spark) as inner:
            assert store.stored(spark.range(5), "numbers").count() == 5
        assert not files(inner.removeprefix("file:"))
    assert not set(files(root)) - before


def test_a_lifetime_ends_with_an_error_too(spark):
    with pytest.raises(ZeroDivisionError), store.lifetime(spark) as folder:
        store.stored(spark.range(5), "numbers")
        raise ZeroDivisionError
    assert not files(folder.removeprefix("file:"))


def test_positions_are_short_and_in_the_order_of_the_paths(spark, tmp_path):
    """Names of which one begins another, with signs that paths write otherwise, in folders; a single file; files of one write."""
    for name in ("b c", "a", "a.x", "é#1", "d%/a.x", "d%/é", "d/a"):
        path = tmp_path / "odd" / f"{name}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"{HEADER}\n2024-01-01,p,{name},1,1,5,10,s,7\n")
    feed = spark.read.option("recursiveFileLookup", True).option("header", True).csv(str(tmp_path / "odd"))
    rows = feed.select(F.col("_metadata.file_path").alias("path"), file_order(feed).alias("short")).collect()
    assert len({r.short for r in rows}) == len(rows) == 7
    assert [r.short for r in sorted(rows, key=lambda r: r.path.encode())] == sorted((r.short for r in rows), key=str.encode)
    assert max(len(r.short) for r in rows) < 12
    one = read_csv(spark, str(tmp_path / "odd" / "a.csv"))
    assert [r[POSITION].file for r in one.collect()] == [""]
    spark.range(40).repartition(20).write.parquet(str(tmp_path / "many"))
    files = [r.file for r in read_parquet(spark, str(tmp_path / "many")).select(f"{POSITION}.file").distinct().collect()]
    assert len(files) >= 10 and max(map(len, files)) <= 2
