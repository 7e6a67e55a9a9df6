"""The input contract: nine named columns, plus an ordering column called ``seq``."""

from __future__ import annotations

import re
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of the input contract, in its order.
NUMERIC_COLUMNS = ["inventory", "units_sold", "unit_cost", "selling_price", "lead_time_days"]
# Added by the readers: where a record stands in its files.
POSITION = "_position"
# How a path begins; the names of files that a session lists and those beside rows differ in slashes here.
SCHEME = re.compile("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*")

INPUT_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("product", T.StringType()),
        T.StructField("category", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in NUMERIC_COLUMNS[:4]],
        T.StructField("supplier", T.StringType()),
        T.StructField("lead_time_days", T.DoubleType()),
    ]
)

REQUIRED_COLUMNS = INPUT_SCHEMA.fieldNames()
TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in INPUT_SCHEMA.fields])


# Texts that are a date, with a time of day or without, and texts that are a number.
DATE_TEXT = (r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
             r"(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\s*$")
NUMBER_TEXT = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def _readable(name: str, pattern: str) -> Column:
    """A column that is not text, or text of this form; the type is known when the plan is made."""
    return (F.typeof(name) != "string") | F.col(name).cast("string").rlike(pattern)


def day(name: str) -> Column:
    """A date; text that is more or less than a date reads as NULL."""
    return F.when(_readable(name, DATE_TEXT), F.col(name).try_cast("date"))


def readable_number(name: str) -> Column:
    """A double; text that is no decimal number reads as NULL."""
    return F.when(_readable(name, NUMBER_TEXT), F.col(name).try_cast("double"))


def number(name: str) -> Column:
    """A double, with text that is no number and NaN both read as NULL."""
    value = readable_number(name)
    return F.when(~F.isnan(value), value)


def missing_columns(df: DataFrame) -> list[str]:
    present = set(df.columns)
    return [name for name in REQUIRED_COLUMNS if name not in present]


def _orders(df: DataFrame, name: str) -> bool:
    return name in df.columns and not isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType))


def _ordering(df: DataFrame, name: str) -> Column:
    """The ordering column, with missing numbers before all others."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))
    return F.col(name)


def _rows_are_numbered(df: DataFrame) -> bool:
    """Whether the rows come straight from files whose format numbers them."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    found = [hidden.apply(n) for n in range(hidden.size())]
    return any(x.name() == "_metadata" and '"row_index"' in x.dataType().json() for x in found)


def file_order(df: DataFrame) -> Column:
    """The file of each row that comes straight from files: as much of its path as tells it from the others that are read.

    Each of a day's last values keeps its position until days are finished, so a position should be short.
    What all paths begin with orders nothing, nor does what follows the characters that differ.
    """
    path = F.col("_metadata.file_path")
    files = [] if df.isStreaming else df.inputFiles()
    if len({SCHEME.match(x)[0] for x in files}) != 1:
        return path
    names = sorted({SCHEME.sub("", x) for x in files})
    common = len(commonprefix([names[0], names[-1]]))
    needed = max((len(commonprefix(pair)) + 1 for pair in zip(names, names[1:])), default=common)
    return F.substring(F.regexp_replace(path, SCHEME.pattern, ""), common + 1, needed - common)


def positioned(df: DataFrame) -> DataFrame:
    """The rows with their position, if they come straight from files whose format numbers its rows."""
    if POSITION in df.columns or "_metadata" in df.columns or not _rows_are_numbered(df):
        return df
    return df.withColumn(POSITION, F.struct(file_order(df).alias("file"), F.col("_metadata.row_index").alias("row")))


def typed(df: DataFrame) -> DataFrame:
    """Project onto the contract: typed columns plus ``seq``, everything else dropped.

    ``seq`` decides which row is "last" within one product and day.  It is taken from a
    column ``seq``, else from ``id``, else from the position in the files: path and row number, which
    are the same however the files are split over tasks.  Only rows that come from no file (or
    through a join or an aggregate) are ordered by their place in the partitions.  Text does not order
    rows (``10`` would come before ``9``) and is passed over; a missing number comes first.
    """
    absent = missing_columns(df)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    if not any(_orders(df, name) for name in ("seq", "id")):
        df = positioned(df)
    order = next((_ordering(df, name) for name in ("seq", "id", POSITION) if _orders(df, name)),
                 F.monotonically_increasing_id())
    casts = {
        "date": day,
        "product": lambda name: F.col(name).cast("string"),
        "category": lambda name: F.col(name).cast("string"),
        "supplier": lambda name: F.col(name).cast("string"),
    }
    return df.select(
        *[casts.get(name, number)(name).alias(name) for name in REQUIRED_COLUMNS],
        order.alias("seq"),
    )
