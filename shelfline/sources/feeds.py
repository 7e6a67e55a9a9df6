"""Ways to get the nine-column daily feed into a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.schema import INPUT_SCHEMA, POSITION, file_order, positioned

# The texts that common CSV tooling reads as "missing".
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


MALFORMED = "_malformed"
#: Put behind a malformed record to see how many fields it has; no text of a feed is this.
END = "\x00end\x00"


def _has_surplus(names: list[str], options: dict) -> Column:
    """Whether a record that does not fit the header has more fields than it, by the parser itself."""
    fields = T.StructType([T.StructField(f"f{n}", T.StringType()) for n in range(len(names) + 1)])
    read = F.from_csv(F.concat(F.col(MALFORMED), F.lit("," + END)), fields.simpleString()[7:-1].replace(":", " "),
                      {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    ends = [F.coalesce(read[f"f{n}"] == END, F.lit(False)) for n in range(len(names) + 1)]
    return ~reduce(lambda a, b: a | b, ends)


def read_csv(spark: SparkSession, path: str, date_format: str | None = None,
             multi_line: bool = False) -> DataFrame:
    """Header CSV as text columns, missing tokens as NULL, plus their position in the files.

    Values stay text so that `validation_report` can tell an unreadable value from a missing one;
    `schema.typed` turns them into numbers and dates.  Columns are taken by name from the header,
    extra ones are kept for the caller and dropped by the roll-up.

    A doubled quote within quotes is one quote.  Quoted line breaks need ``multi_line``, which makes
    each file one task.  A record with more fields than the header is an error when it is read,
    whatever is in them; a shorter one has NULLs at its end.
    """
    parsing = {"escape": '"', "multiLine": multi_line}
    reader = spark.read.options(header=True, mode="PERMISSIVE", **parsing)
    names = reader.csv(path).columns
    fields = [T.StructField(name, T.StringType()) for name in [*names, MALFORMED]]
    read = reader.option("columnNameOfCorruptRecord", MALFORMED).schema(T.StructType(fields)).csv(path)
    fits = F.col(MALFORMED).isNull() | ~_has_surplus(names, parsing)
    raw = read.where(F.when(fits, True).otherwise(
        F.raise_error(F.lit("a CSV record has more fields than its header")).cast("boolean")))
    columns = [F.when(~F.col(f"`{name}`").isin(MISSING_TEXTS), F.col(f"`{name}`")).alias(name)
               for name in names]
    place = F.struct(file_order(raw).alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    table = raw.select(*columns, place.alias(POSITION))
    if date_format is None:
        return table
    day = F.to_char(F.try_to_date("date", date_format), F.lit("yyyy-MM-dd"))
    return table.withColumn("date", F.coalesce(day, F.col("date")))


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """Like `read_csv`, but a path that does not exist gives an empty feed."""
    try:
        return read_csv(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INPUT_SCHEMA)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files with the position of each row in them."""
    return positioned(spark.read.parquet(path))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table, with the position of each row if its files number them."""
    return positioned(spark.table(name))
