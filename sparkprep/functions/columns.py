"""Column access, type families and the meaning of "missing"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names that rules accept.
TYPE_NAMES = ("string", "int", "float", "boolean", "datetime")

# The cell texts that count as missing when text is read.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
_STRING_TYPES = (T.StringType, T.CharType, T.VarcharType)
_DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def qcol(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema.fields[df.columns.index(name)].dataType


def family(dtype: T.DataType) -> str:
    """One of TYPE_NAMES, or "other" for nested, binary and interval types."""
    if isinstance(dtype, _STRING_TYPES):
        return "string"
    if isinstance(dtype, _INT_TYPES):
        return "int"
    if isinstance(dtype, _FLOAT_TYPES):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _DATETIME_TYPES):
        return "datetime"
    return "other"


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans are not numeric."""
    return isinstance(dtype, T.NumericType)


def holds_nan(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_missing(df: DataFrame, name: str) -> Column:
    """True for null and NaN, never null itself.

    ``isnan`` is added for float and double only: a bare ``IS NULL`` is what
    the Parquet reader can evaluate from its statistics.
    """
    c = qcol(name)
    if holds_nan(data_type(df, name)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_present(df: DataFrame, name: str) -> Column:
    """Negation of ``is_missing``, in the form that is pushed to the scan."""
    c = qcol(name)
    if holds_nan(data_type(df, name)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def null_if_nan(df: DataFrame, name: str) -> Column:
    """The value with NaN turned into null."""
    c = qcol(name)
    if holds_nan(data_type(df, name)):
        return F.nanvl(c, F.lit(None).cast(data_type(df, name)))
    return c


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Swap one column's expression, keeping position and exact name."""
    return df.select(
        [value.alias(n) if n == name else qcol(n) for n in df.columns]
    )


def canonicalize_nan(df: DataFrame) -> DataFrame:
    """Null out NaN in every float and double column."""
    if not any(holds_nan(f.dataType) for f in df.schema.fields):
        return df
    return df.select([null_if_nan(df, n).alias(n) for n in df.columns])


def normalize_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null out the missing-value texts in string columns (all, or those named)."""
    chosen = [
        f.name
        for f in df.schema.fields
        if family(f.dataType) == "string" and (columns is None or f.name in columns)
    ]
    return df.select(
        [
            F.when(~qcol(n).isin(*NA_TOKENS), qcol(n)).alias(n) if n in chosen else qcol(n)
            for n in df.columns
        ]
    )
