"""Removing duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkprep.functions.columns import canonicalize_nan, data_type, qcol, replace_column


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep one row of each set of equal rows.

    NaN equals null here. Copies are combined before the shuffle, so a row
    that makes up much of the table is shuffled once per task. Map columns
    cannot be compared and are rejected.
    """
    maps = [f.name for f in df.schema.fields if _holds_map(f.dataType)]
    if maps:
        raise TypeError(f"rows with map columns cannot be compared: {', '.join(maps)}")
    return canonicalize_nan(df).distinct()


def remove_duplicates_within(stream: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Remove equal rows that arrive within ``delay`` of each other.

    State older than the watermark is dropped, so it stays bounded on an
    endless stream. A time without zone is read in the session's zone.
    """
    df = canonicalize_nan(stream)
    if isinstance(data_type(df, time_column), T.TimestampNTZType):
        df = replace_column(df, time_column, qcol(time_column).cast("timestamp"))
    return df.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(df.columns)


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)
