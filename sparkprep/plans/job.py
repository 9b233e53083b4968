"""One preparation job from a JSON spec: read, validate, clean, load, log.

A spec has these parts, all but ``source`` and ``output_table`` optional::

    {
      "pipeline_name": "events",
      "source": {"table": "db.events"}            or
                {"path": "...", "format": "CSV", "header": true, "delimiter": ",",
                 "multi_line": false, "lines": null, "schema": "a int, b string"},
      "validation_config": {... "expectations": [...]},
      "branch": "clean",                          source, clean or error
      "split_path": "...",                        clean and error rows as files
      "split_format": "csv",                      by default the output's
      "split_options": {"multiLine": "true"},     by default the output's, if formats are the same
      "cleaning_config": {"cleaning_steps": [...]},
      "transformations": [...],
      "output_table": "db.events_prepared",
      "output_format": "parquet",
      "output_options": {},
      "output_path": "...",
      "lineage_path": "...",
      "checkpoint": false                         see ``apply_steps``
    }

Source, output, split and log must lie apart: none may be, or hold, another.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from sparkprep.functions.columns import canonicalize_nan
from sparkprep.operators.validate import Rule, suite_from_json, validation_report
from sparkprep.plans import lineage
from sparkprep.plans.cleaning import STEP_LISTS, Branches, StepReport, run_steps, steps_from_spec
from sparkprep.plans.steps import Step
from sparkprep.sources.catalog import table_path
from sparkprep.sources.readers import (
    DEFAULT_FORMAT,
    FILE_FORMATS,
    read_file,
    read_path,
    read_table,
)
from sparkprep.sources.sinks import (
    check_apart,
    check_result,
    existing_location,
    output_location,
    write_split,
    write_table,
)


@dataclass(frozen=True)
class Job:
    """A spec that has been read and checked, before any data is touched."""

    source: Mapping[str, object]
    output_table: str
    rules: tuple[Rule, ...] = ()
    steps: tuple[Step, ...] = ()
    branch: str = "source"
    split_path: str | None = None
    split_format: str = DEFAULT_FORMAT
    split_options: Mapping[str, str] = field(default_factory=dict)
    output_format: str = DEFAULT_FORMAT
    output_options: Mapping[str, str] = field(default_factory=dict)
    output_path: str | None = None
    lineage_path: str | None = None
    checkpoint: bool = False
    name: str = ""


@dataclass(frozen=True)
class JobResult:
    report: StepReport
    validation: DataFrame | None


def job_from_spec(spec: str | Mapping[str, object]) -> Job:
    data = json.loads(spec) if isinstance(spec, str) else spec
    source = data.get("source")
    if not isinstance(source, Mapping) or not (source.get("table") or source.get("path")):
        raise ValueError("the spec names no source table or path")
    if not data.get("output_table"):
        raise ValueError("the spec names no output table")
    if source.get("table") == data["output_table"]:
        raise ValueError(f"{data['output_table']} cannot be both source and output")
    paths = [p for p in (data.get("output_path"), data.get("split_path")) if p]
    if source.get("path") and any(str(p).rstrip("/") == str(source["path"]).rstrip("/") for p in paths):
        raise ValueError(f"{source['path']} cannot be both source and output")
    rules = tuple(suite_from_json(data["validation_config"])) if "validation_config" in data else ()
    output_format, output_options = data.get("output_format", DEFAULT_FORMAT), _texts(data, "output_options")
    split_format = data.get("split_format", output_format)
    same = split_format.lower() == output_format.lower()
    split_options = _texts(data, "split_options") or (output_options if same else {})
    has_steps = "cleaning_config" in data or any(name in data for name in STEP_LISTS)
    return Job(
        source=source,
        output_table=data["output_table"],
        rules=rules,
        steps=tuple(steps_from_spec(data)) if has_steps else (),
        branch=data.get("branch", "clean" if rules else "source"),
        split_path=data.get("split_path"),
        split_format=split_format,
        split_options=split_options,
        output_format=output_format,
        output_options=output_options,
        output_path=data.get("output_path"),
        lineage_path=data.get("lineage_path"),
        checkpoint=bool(data.get("checkpoint", False)),
        name=data.get("pipeline_name", ""),
    )


def _texts(data: Mapping[str, object], name: str) -> dict[str, str]:
    """Options of a format; JSON's true and false as Spark writes them."""
    given = data.get(name) or {}
    if not isinstance(given, Mapping):
        raise ValueError(f"{name} is not a set of options")
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in given.items()}


def read_source(spark: SparkSession, source: Mapping[str, object]) -> DataFrame:
    if source.get("table"):
        return read_table(spark, str(source["table"]))
    name = str(source.get("format", "CSV"))
    if name.upper() in FILE_FORMATS:
        return read_file(spark, str(source["path"]), source)
    return read_path(spark, str(source["path"]), name.lower())


def check_paths(spark: SparkSession, job: Job) -> None:
    """Refuse places that are, or hold, one another, before any data is touched.

    Writing one of them would delete what another one holds, or mix the two.
    """
    table, path = job.source.get("table"), job.source.get("path")
    places = [
        table_path(spark, str(table)) if table else str(path),
        job.output_path or output_location(spark, job.output_table),
        job.split_path,
        job.lineage_path,
    ]
    # A table that is there goes, wherever the new one is to be.
    before = existing_location(spark, job.output_table)
    if before and before != places[1]:
        check_all_apart(spark, [places[0], before, *places[2:]])
    check_all_apart(spark, places)


def check_all_apart(spark: SparkSession, places: Sequence[str | None]) -> None:
    for one, other in combinations([p for p in places if p], 2):
        check_apart(spark, [one], other)


def run_job(spark: SparkSession, job: Job | str | Mapping[str, object]) -> JobResult:
    """Run a job. The validation report in the result is a lazy frame.

    A result without rows is an error, and leaves the output as it was.
    """
    job = job if isinstance(job, Job) else job_from_spec(job)
    check_paths(spark, job)
    branches = Branches(canonicalize_nan(read_source(spark, job.source)), job.rules)
    if job.split_path:
        write_split(
            branches.source,
            job.rules,
            job.split_path,
            job.split_format,
            job.split_options,
            replace=True,
        )
    report = run_steps(
        branches.branch(job.branch),
        job.steps,
        lambda df: write_table(
            df, job.output_table, job.output_format, path=job.output_path, options=job.output_options
        ),
        checkpoint=job.checkpoint,
        ready=check_result,
    )
    if job.lineage_path:
        entries = [
            ("Source", {k: str(v) for k, v in job.source.items()}),
            ("Validation", {"rules": ", ".join(r.name for r in job.rules), "branch": job.branch}),
            *lineage.report_entries(report),
            ("Load", {"table": job.output_table, "format": job.output_format}),
        ]
        lineage.append(spark, job.lineage_path, job.name or job.output_table, entries)
    return JobResult(
        report, validation_report(branches.source, job.rules) if job.rules else None
    )
