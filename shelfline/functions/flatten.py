"""Nested columns as rows of path and value, to compare, export or search them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = "array<struct<path:string,number:double,text:string>>"


def _or_none(leaves: Column) -> Column:
    return F.coalesce(leaves, F.array().cast(LEAF))


def _leaves(value: Column, kind: T.DataType, path: Column, places: int) -> Column:
    """The leaves below a value, with the paths that lead to them."""
    if isinstance(kind, T.StructType):
        fields = [_leaves(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}")), places)
                  for f in kind.fields]
        return F.concat(*fields)
    if isinstance(kind, T.ArrayType):
        return _or_none(F.flatten(F.transform(value, lambda x, n: _leaves(
            x, kind.elementType, F.concat(path, F.lit("["), n.cast("string"), F.lit("]")), places))))
    if isinstance(kind, T.MapType):
        return _or_none(F.flatten(F.transform(F.map_entries(value), lambda e: _leaves(
            e["value"], kind.valueType, F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}")), places))))
    numeric = isinstance(kind, T.NumericType)
    number = F.round(value.cast("double"), places) if numeric else F.lit(None).cast("double")
    text = F.lit(None).cast("string") if numeric else value.cast("string")
    return F.array(F.struct(path.alias("path"), number.alias("number"), text.alias("text"))).cast(LEAF)


def flattened(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """Columns of the keys, path, number and text: a row for each leaf of the other columns.

    Fields are written ``a.b``, elements ``a[0]`` and map entries ``a{key}``.  Numbers are rounded,
    everything else is text.  A missing leaf has neither; a missing or empty array or map has no
    leaves.  Rows are made in place, without a shuffle.
    """
    rest = [f for f in df.schema.fields if f.name not in keys]
    leaves = [_leaves(F.col(f.name), f.dataType, F.lit(f.name), places) for f in rest]
    return df.select(*keys, F.inline(F.concat(*leaves)))
