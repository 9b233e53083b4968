"""Preparing tables with Spark: read, validate, clean, load, keep track."""

from sparkprep.functions.columns import canonicalize_nan, normalize_na
from sparkprep.operators.duplicates import remove_duplicates
from sparkprep.operators.fill import (
    fill_mean,
    fill_median,
    fill_mode,
    fill_value,
)
from sparkprep.operators.filters import drop_missing, filter_equals, has_nulls
from sparkprep.operators.profile import preview, profile_columns, schema_table, shape
from sparkprep.operators.projections import (
    apply_convention,
    drop_column_if_null,
    drop_columns,
    rename_column,
)
from sparkprep.operators.validate import (
    ColumnExists,
    NotNull,
    OfType,
    RowRule,
    error_reasons,
    split,
    suite_from_dict,
    suite_from_json,
    suite_to_json,
    unexpected_sample,
    validation_report,
)
from sparkprep.plans.cleaning import (
    Branches,
    apply_steps,
    remove_nulls_from_table,
    run_steps,
    spec_from_steps,
    steps_from_spec,
)
from sparkprep.plans.steps import (
    Custom,
    DropColumns,
    FillNulls,
    FilterEquals,
    RemoveColumn,
    RemoveDuplicates,
    RemoveNulls,
    RenameColumns,
    Step,
    register_function,
    register_step,
)

__all__ = [
    "Branches",
    "ColumnExists",
    "Custom",
    "DropColumns",
    "FillNulls",
    "FilterEquals",
    "NotNull",
    "OfType",
    "RemoveColumn",
    "RemoveDuplicates",
    "RemoveNulls",
    "RenameColumns",
    "RowRule",
    "Step",
    "apply_convention",
    "apply_steps",
    "canonicalize_nan",
    "drop_column_if_null",
    "drop_columns",
    "drop_missing",
    "error_reasons",
    "fill_mean",
    "fill_median",
    "fill_mode",
    "fill_value",
    "filter_equals",
    "has_nulls",
    "normalize_na",
    "preview",
    "profile_columns",
    "register_function",
    "register_step",
    "remove_duplicates",
    "remove_nulls_from_table",
    "rename_column",
    "run_steps",
    "schema_table",
    "shape",
    "spec_from_steps",
    "split",
    "steps_from_spec",
    "suite_from_dict",
    "suite_from_json",
    "suite_to_json",
    "unexpected_sample",
    "validation_report",
]
