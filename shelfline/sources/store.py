"""Writing an intermediate table once, so that several reports read it instead of recomputing it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folders of the lifetimes that are open, the innermost last.
_open: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse; all executors see both."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/shelfline/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that holds a path, and the path as it wants it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def lifetime(spark: SparkSession) -> Iterator[str]:
    """Tables stored within this context are deleted when it ends, whatever store they are on.

    Results that read them have to be written or collected before that.
    """
    folder = _folder(spark, "tables")
    _open.append(folder)
    try:
        yield folder
    finally:
        _open.remove(folder)
        files, place = _file_system(spark, folder)
        files.delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet and return the table read back.

    This cuts the lineage, survives the loss of executors, and lets every later report prune the
    columns it does not need.  The files are deleted with the innermost `lifetime`; outside of one,
    when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, yet to be written, that lasts as `stored` tables do."""
    path = f"{_open[-1]}/{name}-{uuid.uuid4().hex}" if _open else _folder(spark, name)
    if not _open:
        files, place = _file_system(spark, path)
        files.mkdirs(place)  # only what is there can be marked
        files.deleteOnExit(place)
    return f"{path}/rows"
