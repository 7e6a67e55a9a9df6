"""Input validation: one aggregate for all row counts, one grouping for duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import messages as m
from shelfline.schema import NUMERIC_COLUMNS, REQUIRED_COLUMNS, day, missing_columns, number, readable_number

REPORT_SCHEMA = "check string, severity string, column string, n_rows long, message string"
# Which columns the contract wants not negative, and which never missing.
NON_NEGATIVE = ["inventory", "units_sold", "unit_cost", "selling_price"]
NEVER_MISSING = ["product", "category", "supplier", "unit_cost", "selling_price", "lead_time_days"]
TYPE_CHECKS = ["INVALID_DATE", "NOT_NUMERIC"]


def _missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column; unreadable text is not missing."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _unreadable(df: DataFrame, name: str) -> Column:
    """A value is there but has the wrong type."""
    kind = df.schema[name].dataType
    if name == "date":
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(False)
        return F.col(name).isNotNull() & day(name).isNull()
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.col(name).isNotNull() & readable_number(name).isNull()
    return F.col(name).isNotNull()


def _checks(df: DataFrame) -> list[tuple[str, str, str, Column | None, str]]:
    """(check, severity, column, condition counted, message), in report order."""
    listed = [("INVALID_DATE", "ERROR", "date", _unreadable(df, "date"), m.INVALID_DATES)]
    listed += [("NOT_NUMERIC", "ERROR", name, _unreadable(df, name), m.NOT_NUMERIC.format(name))
               for name in NUMERIC_COLUMNS]
    listed += [("NEGATIVE", "ERROR", name, number(name) < 0, m.NEGATIVE_VALUES.format(name))
               for name in NON_NEGATIVE]
    listed += [
        ("LEAD_TIME", "ERROR", "lead_time_days", number("lead_time_days") <= 0,
         m.LEAD_TIME_NOT_POSITIVE),
        ("DUPLICATE", "WARNING", "product,date", None, m.DUPLICATE_RECORDS),
        ("MISSING_INVENTORY", "WARNING", "inventory", _missing(df, "inventory"),
         m.MISSING_INVENTORY),
    ]
    listed += [("MISSING", "ERROR", name, _missing(df, name), m.MISSING_VALUES.format(name))
               for name in NEVER_MISSING]
    return listed


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many records share product and date with another one (NULLs compare equal)."""
    groups = df.groupBy("product", "date").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n"))


def _counted(raw: DataFrame, checks: list[tuple]) -> DataFrame:
    """One row with the count of every check, as n_0, n_1 and so on, from one scan.

    Counts are first carried per product and date, where records that share both are known, and
    then summed.  Both steps combine on the map side.
    """
    per_day = raw.groupBy("product", "date").agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(condition).alias(f"n_{i}") for i, (*_, condition, _) in enumerate(checks)
        if condition is not None])
    shared = F.when(F.col("rows") > 1, F.col("rows"))
    return per_day.agg(*[
        F.coalesce(F.sum(shared if condition is None else F.col(f"n_{i}")), F.lit(0)).alias(f"n_{i}")
        for i, (*_, condition, _) in enumerate(checks)])


def validation_report(df: DataFrame) -> DataFrame:
    """The violated checks with their row counts, in a fixed order; the input is read once."""
    absent = missing_columns(df)
    if absent:
        found = [("MISSING_COLUMN", "ERROR", ",".join(absent), len(absent),
                  m.MISSING_COLUMNS.format(absent))]
        return df.sparkSession.createDataFrame(found, REPORT_SCHEMA)
    raw = df.select(*REQUIRED_COLUMNS)
    checks = _checks(raw)
    counted = _counted(raw, checks)

    def wording(text: str) -> Column:
        if "{}" not in text:
            return F.lit(text)
        before, after = text.split("{}")
        return F.concat(F.lit(before), F.col("n_rows").cast("string"), F.lit(after))

    blocked = F.lit(False)
    for i, (check, *_) in enumerate(checks):
        if check in TYPE_CHECKS:
            blocked = blocked | (F.col(f"n_{i}") > 0)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(check).alias("check"),
                        F.lit(severity).alias("severity"), F.lit(column).alias("column"),
                        F.col(f"n_{i}").alias("n_rows"), F.lit(text).alias("template"))
               for i, (check, severity, column, _, text) in enumerate(checks)]
    message = F
    for i, (*_, text) in enumerate(checks):
        message = message.when(F.col("position") == i, wording(text))
    return (
        counted.select(blocked.alias("blocked"), F.inline(F.array(*entries)))
        .where(F.col("n_rows") > 0)
        # Values are judged only when every column has the right type.
        .where(~F.col("blocked") | F.col("check").isin(TYPE_CHECKS))
        .select("check", "severity", "column", "n_rows", message.alias("message"))
    )


def verdict(report: DataFrame) -> DataFrame:
    """One row: valid when the report holds no error; warnings do not count against it."""
    errors = F.count_if(F.col("severity") == "ERROR")
    return report.agg((errors == 0).alias("is_valid"), errors.alias("n_errors"),
                      F.count_if(F.col("severity") == "WARNING").alias("n_warnings"))


def require_valid(df: DataFrame) -> DataFrame:
    """The input itself when it passes; otherwise an error that lists what failed."""
    found = validation_report(df).where(F.col("severity") == "ERROR").select("message").collect()
    if found:
        raise ValueError("; ".join(row.message for row in found))
    return df
