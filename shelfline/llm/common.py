"""What several operators of this subpackage share.

Operators read only the columns they name and return their own columns beside the identifier, so columns of
the input that happen to carry a result's name never clash. A null text counts as an empty one unless an
operator says otherwise. Work that runs in Python gets Arrow batches and takes a few rows of them at a time, so that
its memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python function holds as objects at one time.
SLICE_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def settled(frame: DataFrame) -> DataFrame:
    """The same rows, made once: a filter on them stays above, instead of being rewritten over all expressions below."""
    return frame.select(F.inline(F.array(F.struct(*frame.columns))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one the cluster names, else one below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for results that several later jobs read."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder among the shared ones, yet to be written. It goes with the session: the file system that holds it
    deletes it when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)  # only what is there can be marked
    files.deleteOnExit(place)
    return f"{path}/rows"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The same rows from Parquet in the shared folder, for results that several later jobs read in part."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def chunks(items: Iterable, size: int) -> Iterator[list]:
    items = iter(items)
    while some := list(islice(items, size)):
        yield some


def map_slices(frame: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str,
               rows: int = SLICE_ROWS) -> DataFrame:
    """Apply work to small Arrow slices; it returns the columns of schema by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            columns = work(part)
            arrays = [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in target]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type)
                                              for a, f in zip(arrays, target, strict=True)], schema=target)

    return frame.mapInArrow(run, schema)
