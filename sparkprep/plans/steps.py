"""Cleaning steps as immutable values with a JSON form.

A step is a function from a frame to a frame. It also says what its report
needs to count, and how to tell from the schema or from those counts that it
had nothing to do.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import data_type, has_column, is_missing, is_numeric
from sparkprep.functions.naming import CONVENTIONS
from sparkprep.functions.statistics import (
    approximate_median_of,
    mean_of,
    median_field,
    median_of,
    medians_of,
    mode_of,
)
from sparkprep.operators import fill as fills
from sparkprep.operators.duplicates import remove_duplicates, remove_duplicates_within
from sparkprep.operators.filters import (
    drop_missing,
    equals,
    filter_equals,
    parse_filter,
    rows_present,
)
from sparkprep.operators.projections import (
    ALL_COLUMNS,
    apply_convention,
    contains_missing,
    drop_column_if_null,
    drop_columns,
    rename_column,
)


# Step types in specs.
FILL_NULLS = "fill_null_data"
REMOVE_NULLS = "remove_null_data"
RENAME_COLUMNS = "rename_columns"
DROP_COLUMNS = "drop_columns"
REMOVE_DUPLICATES = "remove_duplicates"
FILTER = "Filter"
REMOVE_COLUMN = "Remove Column"

# Strategies of null removal, and the rename by name.
DROP_ROWS_ANY = "drop_rows_any"
DROP_ROWS_COL = "drop_rows_col"
DROP_COLUMN = "drop_column"
SPECIFIC_RENAME = "specific_rename"

# Reasons for skipping a step.
NOT_FOUND = "Column '{}' not found."
NO_NULL_VALUES = "Column '{}' has no null values."
NOT_NUMERIC = "Cannot fill {} for non-numeric column '{}'."
NO_MODE = "Could not determine mode for column '{}'."
NO_FILL_VALUE = "Fill value not provided for specific fill strategy."
NO_VALID_COLUMNS = "No valid columns for drop_rows_col."
NO_NULLS = "Column '{}' has no nulls."
RENAME_NOT_FOUND = "Column '{}' not found for specific rename."


class Step(ABC):
    """Subclass and decorate with ``register_step`` to add a step."""

    type: str = ""
    # Whether the step can change the number of rows, whether it shuffles, and
    # whether it leaves every value as it is (it only renames or drops columns).
    changes_rows = False
    shuffles = False
    keeps_values = False

    @abstractmethod
    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        """The step's result; statistics are taken from ``stats`` if given."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    @property
    def title(self) -> str:
        """The step as one line of text."""
        shown = ", ".join(
            f"{k}={','.join(map(str, v)) if isinstance(v, list) else v}"
            for k, v in self.params().items()
        )
        return f"{self.type}({shown})"

    def params(self) -> dict:
        """The step's settings, without those that are unset."""
        return {}

    def to_dict(self) -> dict:
        return {"type": self.type, **self.params()}

    def typed_params(self) -> dict:
        """Settings as ``{name: {"value": text, "type": type name}}``."""
        return {
            k: {
                "value": json.dumps(v) if isinstance(v, (list, tuple)) else str(v),
                "type": "str" if isinstance(v, (list, tuple)) else type(v).__name__,
            }
            for k, v in self.params().items()
        }

    def settle(self, df: DataFrame) -> Step:
        """The step with everything decided that needs a look at the data."""
        return self

    def condition(self, df: DataFrame) -> Column | None:
        """Which rows stay, if that is all that the step does to them."""
        return None

    def counts(self, df: DataFrame) -> dict[str, Column]:
        """Conditions on the rows of the step's input, to be counted for its report."""
        return {}

    def metrics(self, df: DataFrame, stats: DataFrame | None = None) -> dict[str, Column]:
        """Other aggregates over the step's input that its report needs."""
        return {}

    def skip_reason(self, df: DataFrame) -> str | None:
        """Why the step does nothing to a frame with this schema."""
        return None

    def data_skip_reason(self, found: Mapping[str, object]) -> str | None:
        """Why the step had nothing to do, given its metrics."""
        return None

    def details(self, df: DataFrame, found: Mapping[str, object]) -> dict[str, str]:
        """What the report says about a step that was applied."""
        return {k: str(v) for k, v in self.params().items()}


def _set(**settings: object) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in settings.items() if v is not None}


STEP_TYPES: dict[str, Callable[..., Step]] = {}


def register_step(factory: Callable[..., Step]) -> Callable[..., Step]:
    """Make a step class usable in specs, under its ``type``."""
    STEP_TYPES[factory.type] = factory
    return factory


@register_step
@dataclass(frozen=True)
class FillNulls(Step):
    column: str
    strategy: str
    fill_value: object = None
    approx: bool = False
    only_if_nulls: bool = True

    type = FILL_NULLS

    def __post_init__(self) -> None:
        if not self.column or not self.strategy:
            raise ValueError("a fill needs a column and a strategy")
        if self.strategy not in fills.STRATEGIES:
            raise ValueError(f"unknown fill strategy {self.strategy!r}")

    def apply(
        self, df: DataFrame, stats: DataFrame | None = None, median: Column | None = None
    ) -> DataFrame:
        if self.strategy == fills.MEAN:
            return fills.fill_mean(df, self.column, stats=stats)
        if self.strategy == fills.MEDIAN:
            return fills.fill_median(df, self.column, self.approx, stats, median)
        if self.strategy == fills.MODE:
            return fills.fill_mode(df, self.column, stats=stats)
        return fills.fill_value(
            df, self.column, self.fill_value, only_if_nulls=self.only_if_nulls, stats=stats
        )

    def params(self) -> dict:
        return _set(
            column=self.column,
            strategy=self.strategy,
            fill_value=self.fill_value,
            approx=self.approx or None,
            only_if_nulls=None if self.only_if_nulls else False,
        )

    def skip_reason(self, df: DataFrame) -> str | None:
        if not has_column(df, self.column):
            return NOT_FOUND.format(self.column)
        if self.strategy in (fills.MEAN, fills.MEDIAN):
            if not is_numeric(data_type(df, self.column)):
                kind = self.strategy.removeprefix("fill_")
                return NOT_NUMERIC.format(kind, self.column)
        if self.strategy == fills.MODE and not fills.has_mode(df, self.column):
            return NO_MODE.format(self.column)
        if self.strategy == fills.SPECIFIC and self.fill_value is None:
            return NO_FILL_VALUE
        return None

    def counts(self, df: DataFrame) -> dict[str, Column]:
        return {"missing": is_missing(df, self.column)}

    def statistic(self, source: DataFrame, median: Column | None = None) -> Column | None:
        """What is filled in, as a scalar."""
        if self.strategy == fills.MEAN:
            return mean_of(source, self.column)
        if self.strategy == fills.MEDIAN:
            if median is not None:
                return median
            find = approximate_median_of if self.approx else median_of
            return find(source, self.column)
        if self.strategy == fills.MODE:
            return mode_of(source, self.column)
        return None

    def takes_exact_median(self, df: DataFrame) -> bool:
        return (
            self.strategy == fills.MEDIAN
            and not self.approx
            and fills.takes_number(df, self.column)
        )

    def data_skip_reason(self, found: Mapping[str, object]) -> str | None:
        if not found.get("missing"):
            return NO_NULL_VALUES.format(self.column)
        if self.strategy == fills.MODE and found.get("statistic") is None:
            return NO_MODE.format(self.column)
        return None

    def details(self, df: DataFrame, found: Mapping[str, object]) -> dict[str, str]:
        shown = super().details(df, found)
        shown["filled"] = str(found.get("missing"))
        if "statistic" in found:
            shown["filled_value_actual"] = str(found["statistic"])
        return shown


def medians_for(run: Sequence[FillNulls], source: DataFrame) -> tuple[Column | None, list[str | None]]:
    """The medians that a run of fills needs, as one scalar, and the field of each fill's."""
    names = list(dict.fromkeys(s.column for s in run if s.takes_exact_median(source)))
    if not names:
        return None, [None] * len(run)
    fields = [
        median_field(names.index(s.column)) if s.takes_exact_median(source) else None for s in run
    ]
    return medians_of(source, names), fields


def apply_fills(df: DataFrame, run: Sequence[FillNulls], source: DataFrame) -> DataFrame:
    """Apply fills that take their statistics from one frame, all medians in the same passes."""
    medians, fields = medians_for(run, source)
    if medians is None:
        return reduce(lambda out, step: step.apply(out, source), run, df)
    # One column beside the others, so that the plan has the passes once.
    beside = "_medians"
    while beside in {n.lower() for n in df.columns}:
        beside += "_"
    out = df.select("*", medians.alias(beside))
    for step, name in zip(run, fields, strict=True):
        out = step.apply(out, source, F.col(beside)[name] if name else None)
    return out.drop(beside)


@register_step
@dataclass(frozen=True)
class RemoveNulls(Step):
    strategy: str
    columns_to_check: tuple[str, ...] | None = None
    column_to_drop: str | None = None
    how: str = "any"

    type = REMOVE_NULLS

    def __post_init__(self) -> None:
        if self.strategy not in (DROP_ROWS_ANY, DROP_ROWS_COL, DROP_COLUMN):
            raise ValueError(f"unknown removal strategy {self.strategy!r}")
        if self.columns_to_check is not None:
            object.__setattr__(self, "columns_to_check", tuple(self.columns_to_check))
        if self.strategy == DROP_ROWS_COL and not self.columns_to_check:
            raise ValueError(f"{DROP_ROWS_COL} needs columns to check")
        if self.strategy == DROP_COLUMN and not self.column_to_drop:
            raise ValueError(f"{DROP_COLUMN} needs a column")
        if self.how not in ("any", "all"):
            raise ValueError(f"how must be 'any' or 'all', not {self.how!r}")

    @property
    def changes_rows(self) -> bool:
        return self.strategy != DROP_COLUMN

    @property
    def keeps_values(self) -> bool:
        return self.strategy == DROP_COLUMN

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        if self.strategy == DROP_COLUMN:
            return drop_column_if_null(df, self.column_to_drop, stats)
        return drop_missing(df, self._checked, self.how)

    @property
    def _checked(self) -> tuple[str, ...] | None:
        return self.columns_to_check if self.strategy == DROP_ROWS_COL else None

    def condition(self, df: DataFrame) -> Column | None:
        return rows_present(df, self._checked, self.how) if self.changes_rows else None

    def params(self) -> dict:
        return _set(
            strategy=self.strategy,
            columns_to_check=self.columns_to_check,
            column_to_drop=self.column_to_drop,
            how=None if self.how == "any" else self.how,
        )

    def skip_reason(self, df: DataFrame) -> str | None:
        if self.strategy == DROP_ROWS_COL and not set(self.columns_to_check) & set(df.columns):
            return NO_VALID_COLUMNS
        if self.strategy == DROP_COLUMN and not has_column(df, self.column_to_drop):
            return NOT_FOUND.format(self.column_to_drop)
        return None

    def settle(self, df: DataFrame) -> Step:
        if self.strategy != DROP_COLUMN or self.skip_reason(df):
            return self
        return SettledColumnDrop(self.column_to_drop, contains_missing(df, self.column_to_drop))


def settle_column_drops(df: DataFrame, steps: Sequence[Step]) -> list[Step]:
    """The run of "drop the column if it has nulls" that the steps begin with, settled.

    One look at the data for all of them: an aggregate, or for a single step a
    probe that stops at the first missing value.
    """
    run = list(takewhile(lambda s: isinstance(s, RemoveNulls) and s.strategy == DROP_COLUMN, steps))
    names = {s.column_to_drop for s in run if not s.skip_reason(df)}
    if len(names) < 2:
        return [run[0].settle(df)] if run else []
    order = sorted(names)
    row = df.agg(*(F.max(is_missing(df, n)).alias(f"c{i}") for i, n in enumerate(order))).first()
    found = {n: bool(row[f"c{i}"]) for i, n in enumerate(order)}
    return [
        SettledColumnDrop(s.column_to_drop, found[s.column_to_drop]) if not s.skip_reason(df) else s
        for s in run
    ]


@dataclass(frozen=True)
class SettledColumnDrop(Step):
    """"Drop the column if it has nulls", after the look at the data."""

    column: str
    found: bool

    type = REMOVE_NULLS
    keeps_values = True

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return drop_columns(df, [self.column]) if self.found else df

    def params(self) -> dict:
        return {"strategy": DROP_COLUMN, "column_to_drop": self.column}

    def skip_reason(self, df: DataFrame) -> str | None:
        if not has_column(df, self.column):
            return NOT_FOUND.format(self.column)
        return None if self.found else NO_NULLS.format(self.column)


@register_step
@dataclass(frozen=True)
class RenameColumns(Step):
    rename_type: str
    old_name: str | None = None
    new_name: str | None = None
    columns_to_transform: tuple[str, ...] | str | None = None

    type = RENAME_COLUMNS
    keeps_values = True

    def __post_init__(self) -> None:
        if self.rename_type == SPECIFIC_RENAME:
            if not self.old_name or not self.new_name:
                raise ValueError("a rename needs the old and the new name")
        elif self.rename_type not in CONVENTIONS:
            raise ValueError(f"unknown rename type {self.rename_type!r}")
        elif not self.columns_to_transform:
            raise ValueError("a naming convention needs columns, or '*' for all")
        if self.columns_to_transform is not None and self.columns_to_transform != ALL_COLUMNS:
            object.__setattr__(self, "columns_to_transform", tuple(self.columns_to_transform))

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        if self.rename_type == SPECIFIC_RENAME:
            return rename_column(df, self.old_name, self.new_name)
        return apply_convention(df, self.rename_type, self.columns_to_transform)

    def params(self) -> dict:
        return _set(
            rename_type=self.rename_type,
            old_name=self.old_name,
            new_name=self.new_name,
            columns_to_transform=self.columns_to_transform,
        )

    def skip_reason(self, df: DataFrame) -> str | None:
        if self.rename_type == SPECIFIC_RENAME and not has_column(df, self.old_name):
            return RENAME_NOT_FOUND.format(self.old_name)
        return None

    def details(self, df: DataFrame, found: Mapping[str, object]) -> dict[str, str]:
        pairs = zip(df.columns, self.apply(df).columns)
        changes = [f"{old} -> {new}" for old, new in pairs if old != new]
        return {**super().details(df, found), "changes": ", ".join(changes)}


@register_step
@dataclass(frozen=True)
class DropColumns(Step):
    columns_to_drop: tuple[str, ...]

    type = DROP_COLUMNS
    keeps_values = True

    def __post_init__(self) -> None:
        if not self.columns_to_drop:
            raise ValueError("name at least one column to drop")
        object.__setattr__(self, "columns_to_drop", tuple(self.columns_to_drop))

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return drop_columns(df, self.columns_to_drop)

    def params(self) -> dict:
        return _set(columns_to_drop=self.columns_to_drop)

    def details(self, df: DataFrame, found: Mapping[str, object]) -> dict[str, str]:
        absent = [n for n in self.columns_to_drop if not has_column(df, n)]
        present = [n for n in self.columns_to_drop if has_column(df, n)]
        return {"columns_dropped": ", ".join(present), "columns_not_found": ", ".join(absent)}


@register_step
@dataclass(frozen=True)
class RemoveDuplicates(Step):
    """On a stream, ``time_column`` and ``delay`` say how far apart copies may arrive."""

    time_column: str | None = None
    delay: str | None = None

    type = REMOVE_DUPLICATES
    changes_rows = True
    shuffles = True

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        if not df.isStreaming:
            return remove_duplicates(df)
        if not self.time_column or not self.delay:
            raise ValueError("duplicates in a stream need a time column and a delay")
        return remove_duplicates_within(df, self.time_column, self.delay)

    def params(self) -> dict:
        return _set(time_column=self.time_column, delay=self.delay)


@register_step
@dataclass(frozen=True)
class FilterEquals(Step):
    """The "Filter" transform."""

    column: str
    value: str

    type = FILTER
    changes_rows = True

    def __post_init__(self) -> None:
        if not self.column:
            raise ValueError("a filter needs a column")

    @classmethod
    def parse(cls, text: str) -> FilterEquals:
        return cls(*parse_filter(text))

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return filter_equals(df, self.column, self.value)

    def condition(self, df: DataFrame) -> Column | None:
        return equals(df, self.column, self.value)

    def params(self) -> dict:
        return {"column": self.column, "value": self.value}

    def skip_reason(self, df: DataFrame) -> str | None:
        return None if has_column(df, self.column) else NOT_FOUND.format(self.column)


@register_step
@dataclass(frozen=True)
class RemoveColumn(Step):
    """The "Remove Column" transform."""

    columns: tuple[str, ...]

    type = REMOVE_COLUMN
    keeps_values = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return drop_columns(df, self.columns)

    def params(self) -> dict:
        return _set(columns=self.columns)


@dataclass(frozen=True)
class Custom(Step):
    """Any function from a frame to a frame. It is taken to change the number
    of rows and to shuffle, unless it says otherwise."""

    function: Callable[[DataFrame], DataFrame]
    name: str = ""
    changes_rows: bool = True
    shuffles: bool = True
    settings: Mapping[str, object] = field(default_factory=dict)

    type = "custom"

    def apply(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return self.function(df)

    @property
    def title(self) -> str:
        return self.name or getattr(self.function, "__name__", "custom")

    def params(self) -> dict:
        return dict(self.settings)

    def to_dict(self) -> dict:
        if self.name not in STEP_TYPES:
            raise TypeError(f"register {self.title!r} to use it in a spec")
        return {"type": self.name, **self.params()}


def register_function(name: str, function: Callable[..., DataFrame]) -> None:
    """Make ``function(df, **settings)`` usable in specs, under ``name``."""

    def build(**settings: object) -> Step:
        return Custom(lambda df: function(df, **settings), name, settings=settings)

    STEP_TYPES[name] = build


def step_from_dict(entry: Mapping) -> Step:
    settings = {k: v for k, v in entry.items() if k != "type"}
    kind = entry.get("type")
    if kind not in STEP_TYPES:
        raise ValueError(f"unknown step type {kind!r}")
    return STEP_TYPES[kind](**settings)


def read_list(text: object) -> list | None:
    """A list, or JSON text of one; anything unreadable counts as not given."""
    if not isinstance(text, str):
        return text
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return None
    return found if isinstance(found, list) else None


_LISTS = ("columns_to_check", "columns_to_transform", "columns_to_drop", "columns")
_PARSERS: dict[str, Callable[[str], object]] = {
    "int": int,
    "float": float,
    "bool": lambda text: text.strip().lower() == "true",
}


def step_from_typed_params(kind: str, params: Mapping[str, Mapping[str, str]]) -> Step:
    """A step from ``{name: {"value": text, "type": type name}}``."""
    settings: dict[str, object] = {"type": kind}
    for name, cell in params.items():
        text = cell["value"]
        if name in _LISTS and text != ALL_COLUMNS:
            settings[name] = read_list(text)
        else:
            settings[name] = _PARSERS.get(cell.get("type", "str"), str)(text)
    return step_from_dict(settings)


def steps_to_dicts(steps: Sequence[Step]) -> list[dict]:
    return [s.to_dict() for s in steps]
