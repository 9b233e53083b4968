"""Validation rules, their report, and the split into clean and error rows.

A rule is a small immutable value that yields a boolean ``Column`` which is
true for failing rows and never null. A suite is a list of rules; the report
is one aggregate over the data and the split is a predicate, so every failing
row goes to the error side and clean and error together are the input.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import (
    TYPE_NAMES,
    data_type,
    family,
    has_column,
    is_missing,
    is_present,
    qcol,
)
from sparkprep.functions.naming import snake_case

FAILED = "_failed"
SAMPLE_SIZE = 20

# The texts accepted as each type.
INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN_TEXTS = ("true", "false")
DATETIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"

# Rule names in suite files.
COLUMN_EXISTS = "expect_column_to_exist"
NOT_NULL = "expect_column_values_to_not_be_null"
OF_TYPE = "expect_column_values_to_be_of_type"


class Rule(ABC):
    """Subclass to add a rule; ``register_rule`` lets suite files use it."""

    column: str

    @property
    @abstractmethod
    def name(self) -> str:
        """Label of the rule in reports."""

    @abstractmethod
    def fails(self, df: DataFrame) -> Column | None:
        """Row predicate, or None if the rule does not look at rows."""

    def holds_for_table(self, df: DataFrame) -> bool:
        """Outcome of the part of the rule that needs only the schema."""
        return has_column(df, self.column)

    @abstractmethod
    def to_dict(self) -> dict:
        """The rule as an entry of a suite file."""


@dataclass(frozen=True)
class ColumnExists(Rule):
    column: str

    @property
    def name(self) -> str:
        return f"column_exists({self.column})"

    def fails(self, df: DataFrame) -> Column | None:
        return None

    def to_dict(self) -> dict:
        return {"expectation_type": COLUMN_EXISTS, "kwargs": {"column": self.column}}


@dataclass(frozen=True)
class NotNull(Rule):
    column: str

    @property
    def name(self) -> str:
        return f"not_null({self.column})"

    def fails(self, df: DataFrame) -> Column | None:
        return is_missing(df, self.column) if has_column(df, self.column) else None

    def to_dict(self) -> dict:
        return {"expectation_type": NOT_NULL, "kwargs": {"column": self.column}}


@dataclass(frozen=True)
class OfType(Rule):
    """Text is checked row by row; other columns by their declared type."""

    column: str
    type: str

    def __post_init__(self) -> None:
        if self.type not in TYPE_NAMES:
            raise ValueError(f"type must be one of {', '.join(TYPE_NAMES)}, not {self.type!r}")

    @property
    def name(self) -> str:
        return f"of_type({self.column}, {self.type})"

    def _is_text(self, df: DataFrame) -> bool:
        return has_column(df, self.column) and family(data_type(df, self.column)) == "string"

    def holds_for_table(self, df: DataFrame) -> bool:
        if not has_column(df, self.column):
            return False
        return self._is_text(df) or family(data_type(df, self.column)) == self.type

    def fails(self, df: DataFrame) -> Column | None:
        if not self._is_text(df) or self.type == "string":
            return None
        return qcol(self.column).isNotNull() & ~reads_as(qcol(self.column), self.type)

    def to_dict(self) -> dict:
        return {
            "expectation_type": OF_TYPE,
            "kwargs": {"column": self.column, "type": self.type},
        }


@dataclass(frozen=True)
class RowRule(Rule):
    """A rule given as a function from a frame to a failing-row predicate."""

    column: str
    label: str
    predicate: object

    @property
    def name(self) -> str:
        return self.label

    def fails(self, df: DataFrame) -> Column | None:
        if not has_column(df, self.column):
            return None
        return F.coalesce(self.predicate(df), F.lit(False))

    def to_dict(self) -> dict:
        raise TypeError(f"{self.label} is a function and cannot be written to a suite file")


def reads_as(text: Column, type_name: str) -> Column:
    """Whether a non-null text is a value of the type; never null for such."""
    if type_name == "int":
        return text.rlike(INT_TEXT)
    if type_name == "float":
        return text.rlike(FLOAT_TEXT)
    if type_name == "boolean":
        return F.lower(text).isin(*BOOLEAN_TEXTS)
    if type_name == "datetime":
        return text.rlike(DATETIME_TEXT) & text.try_cast("timestamp").isNotNull()
    return F.lit(True)


def admissible(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules to run: those on present columns, and every existence rule."""
    return [r for r in rules if isinstance(r, ColumnExists) or has_column(df, r.column)]


def _row_rules(df: DataFrame, rules: Sequence[Rule]) -> list[tuple[str, Column]]:
    tested = [(r.name, r.fails(df)) for r in rules]
    return [(name, failing) for name, failing in tested if failing is not None]


def validation_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule, from a single pass over the data.

    (rule, column, success, element_count, unexpected_count,
    unexpected_percent). A rule on an absent column, or on a column of another
    declared type, fails without unexpected rows.
    """
    if not rules:
        raise ValueError("a report needs at least one rule")
    total = F.count(F.lit(1))
    rows = []
    for rule in rules:
        failing = rule.fails(df)
        bad = F.lit(0).cast("bigint") if failing is None else F.count_if(failing)
        rows.append(
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.column).alias("column"),
                (F.lit(rule.holds_for_table(df)) & (bad == 0)).alias("success"),
                total.alias("element_count"),
                bad.alias("unexpected_count"),
                F.round(F.coalesce(F.try_divide(bad * 100.0, total), F.lit(0.0)), 6).alias(
                    "unexpected_percent"
                ),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def suite_success(report: DataFrame) -> DataFrame:
    """One row: did every rule of the report succeed?"""
    return report.agg(F.bool_and("success").alias("success"))


def with_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``_failed``: the names of the rules each row fails."""
    marks = [F.when(failing, F.lit(name)) for name, failing in _row_rules(df, rules)]
    reasons = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return df.withColumn(FAILED, reasons)


def clean_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that fail no rule; null checks reach the scan."""
    tests = []
    for rule in rules:
        failing = rule.fails(df)
        if failing is not None:
            tests.append(is_present(df, rule.column) if isinstance(rule, NotNull) else ~failing)
    return df.where(reduce(and_, tests)) if tests else df


def any_failure(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """Whether a row fails at least one rule; never null."""
    tests = [failing for _, failing in _row_rules(df, rules)]
    return reduce(or_, tests) if tests else F.lit(False)


def error_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that fail at least one rule."""
    return df.where(any_failure(df, rules))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(clean, error), which together hold exactly the input's rows."""
    return clean_rows(df, rules), error_rows(df, rules)


def error_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, rows): how many rows fail each rule that has failures."""
    counts = [
        F.struct(F.lit(name).alias("rule"), F.count_if(failing).alias("rows"))
        for name, failing in _row_rules(df, rules)
    ]
    if not counts:
        return df.sparkSession.createDataFrame([], "rule string, rows bigint")
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts")).where("rows > 0")


def unexpected_sample(
    df: DataFrame, rules: Sequence[Rule], key: str, size: int = SAMPLE_SIZE
) -> DataFrame:
    """Up to ``size`` failing rows per rule, lowest keys first, with ``rule``.

    The row-number limit is applied in each task before the shuffle, so a rule
    that most rows fail still moves only ``size`` rows per task.
    """
    marked = with_reasons(df, rules).select(F.explode(FAILED).alias("rule"), *map(qcol, df.columns))
    ranked = marked.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("rule").orderBy(qcol(key)))
    )
    return ranked.where(F.col("_rank") <= size).drop("_rank")


# --- suites as data -------------------------------------------------------

_READERS = {
    COLUMN_EXISTS: lambda column, kwargs: ColumnExists(column),
    NOT_NULL: lambda column, kwargs: NotNull(column),
    OF_TYPE: lambda column, kwargs: OfType(column, kwargs["type"]),
}


def register_rule(expectation_type: str, reader) -> None:
    """Let suite files use a further rule; ``reader(column, kwargs)`` builds it."""
    _READERS[expectation_type] = reader


def rule_from_dict(entry: Mapping) -> Rule:
    """One rule; the name may be snake_case or CamelCase, the type may stand
    in the arguments or beside them as ``expected_type``."""
    name = snake_case(entry["expectation_type"])
    if name not in _READERS:
        raise ValueError(f"unknown rule {entry['expectation_type']!r}")
    kwargs = dict(entry.get("kwargs", {}))
    if "type" not in kwargs and "expected_type" in entry:
        kwargs["type"] = entry["expected_type"]
    if not kwargs.get("column"):
        raise ValueError(f"rule {entry['expectation_type']!r} names no column")
    if name == OF_TYPE and "type" not in kwargs:
        raise ValueError(f"rule {entry['expectation_type']!r} names no type")
    return _READERS[name](kwargs["column"], kwargs)


def _find_entries(node: object) -> list | None:
    """The ``expectations`` list, at whatever depth of the envelope it is."""
    if isinstance(node, Mapping):
        if isinstance(node.get("expectations"), list):
            return node["expectations"]
        for child in node.values():
            found = _find_entries(child)
            if found is not None:
                return found
    return None


def suite_from_json(text: str | Mapping | Sequence) -> list[Rule]:
    """Read a suite, bare or inside its envelope."""
    data = json.loads(text) if isinstance(text, str) else text
    entries = data if isinstance(data, list) else _find_entries(data)
    if entries is None:
        raise ValueError("no 'expectations' list found")
    return [rule_from_dict(e) for e in entries]


def suite_from_dict(spec: Mapping[str, str | Sequence[str]]) -> list[Rule]:
    """Read ``{rule name: column or list of columns}``."""
    return [
        rule_from_dict({"expectation_type": name, "kwargs": {"column": column}})
        for name, columns in spec.items()
        for column in ([columns] if isinstance(columns, str) else columns)
    ]


def suite_for(df: DataFrame, suite: str | Mapping | Sequence) -> list[Rule]:
    """A suite as data, built for a frame: without rules on columns it lacks.

    Rules that a column exists are kept, as it is for them to tell.
    """
    is_plain = isinstance(suite, Mapping) and _find_entries(suite) is None
    return admissible(df, suite_from_dict(suite) if is_plain else suite_from_json(suite))


def suite_to_json(rules: Sequence[Rule], data_asset_type: str = "SparkDFDataset") -> str:
    return json.dumps(
        {"data_asset_type": data_asset_type, "expectations": [r.to_dict() for r in rules]}
    )
