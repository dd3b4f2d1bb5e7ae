"""What may be broadcast: tables whose bytes have been added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join is broadcast; every executor holds them some three times over.
MOST_BYTES = 64 << 20
_ROW, _FIELD = 16, 8


def _width(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + _FIELD
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + _width(x, kind.elementType))
        return F.coalesce(each, F.lit(0)) + _FIELD
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(_FIELD))
    if isinstance(kind, T.MapType):
        return _width(F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return F.lit(_FIELD)


def bytes_of(df: DataFrame) -> int:
    """About the bytes of all rows: one pass, one number to the driver."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(_ROW))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def small(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """df, marked for a broadcast if its rows take up to `most` bytes; else as it is, and Spark shuffles the join."""
    return F.broadcast(df) if bytes_of(df) <= most else df
