"""Renaming and dropping columns.

Names are matched exactly, with case. The final name list is worked out on the
driver and applied by position, so frames whose names differ only in case, or
hold dots and spaces, are handled like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkprep.functions.columns import has_column, is_missing
from sparkprep.functions.naming import CONVENTIONS, check_names

ALL_COLUMNS = "*"


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the columns that are present; others are ignored."""
    kept = [i for i, n in enumerate(df.columns) if n not in columns]
    if len(kept) == len(df.columns):
        return df
    names = df.columns
    placed = df.toDF(*[f"c{i}" for i in range(len(names))])
    return placed.select([f"c{i}" for i in kept]).toDF(*[names[i] for i in kept])


def contains_missing(df: DataFrame, column: str) -> bool:
    """Eager probe that stops at the first missing value."""
    return not df.where(is_missing(df, column)).select(is_missing(df, column)).isEmpty()


def drop_column_if_null(
    df: DataFrame, column: str, stats: DataFrame | None = None
) -> DataFrame:
    """Drop a column only if it has a missing value (in ``stats``, if given).

    The result's schema depends on the data, so this is the one step that
    looks at the data while the plan is being built.
    """
    if has_column(df, column) and contains_missing(df if stats is None else stats, column):
        return drop_columns(df, [column])
    return df


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column; an absent column leaves the frame unchanged."""
    return with_names(df, [new if n == old else n for n in df.columns])


def renamed_names(names: Sequence[str], convention: str, columns: Sequence[str] | str) -> list[str]:
    """Names after applying a convention to the chosen columns, one at a time."""
    convert = CONVENTIONS[convention]
    result = list(names)
    for column in list(names) if columns == ALL_COLUMNS else columns:
        result = [convert(n) if n == column else n for n in result]
    return result


def apply_convention(
    df: DataFrame, convention: str, columns: Sequence[str] | str = ALL_COLUMNS
) -> DataFrame:
    return with_names(df, renamed_names(df.columns, convention, columns))


def with_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if list(names) == df.columns:
        return df
    return df.toDF(*check_names(list(names)))
