"""Applying cleaning steps: one lazy plan, an exact report, specs, branches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.operators.validate import Rule, clean_rows, error_rows
from sparkprep.plans.steps import (
    DROP_COLUMN,
    DROP_ROWS_ANY,
    DROP_ROWS_COL,
    FillNulls,
    RemoveNulls,
    Step,
    apply_fills,
    medians_for,
    read_list,
    settle_column_drops,
    step_from_dict,
    steps_to_dicts,
)
from sparkprep.session import new_path
from sparkprep.sources.readers import DEFAULT_FORMAT
from sparkprep.sources.sinks import delete_path, write_table

APPLIED, SKIPPED = "applied", "skipped"
# Names of what is taken for the report: a fill's value, and all medians of a run of fills.
STATISTIC, MEDIANS = "statistic", "medians"

REPORT_SCHEMA = (
    "seq bigint, step string, status string, reason string, initial_rows bigint, "
    "initial_columns bigint, final_rows bigint, final_columns bigint, "
    "details map<string,string>"
)


@dataclass(frozen=True)
class Stage:
    """One step with the frame it is applied to and the frame its statistics
    come from."""

    step: Step
    frame: DataFrame
    stats: DataFrame


def stages(
    df: DataFrame, steps: Sequence[Step], checkpoint: bool = False
) -> tuple[list[Stage], DataFrame, Sequence[Step]]:
    """Lay out steps on ``df``: the stages, the frame after them, steps left.

    Filling one column does not change another's statistics, so a run of fills
    takes all of them from the frame ahead of the run, where Catalyst can merge
    them into one aggregate. Renamed and dropped columns are carried along. A
    step that changes rows, or a second fill of a column, makes the next fill
    start a new run, and each statistic of that run contains all that comes
    before it. With ``checkpoint``, the steps from there on are left over, to be
    laid out on the written result of the others.

    Columns to drop if they have nulls are looked up for a whole run of such
    steps at once.
    """
    laid, stats, filled = [], df, set()
    settled: list[Step] = []
    done = 0
    for i, step in enumerate(steps):
        if i < done:
            continue
        if isinstance(step, FillNulls):
            if stats is None or step.column in filled:
                if checkpoint:
                    return laid, df, steps[i:]
                stats, filled = df, set()
            run = _run_of_fills(steps[i:], filled)
            laid += [Stage(s, df, stats) for s in run]
            df = apply_fills(df, run, stats)
            filled |= {s.column for s in run}
            done = i + len(run)
            continue
        if isinstance(step, RemoveNulls) and step.strategy == DROP_COLUMN:
            settled = settled or settle_column_drops(df, steps[i:])
            step = settled.pop(0)
        else:
            step = step.settle(df)
        source = df if stats is None else stats
        laid.append(Stage(step, df, source))
        after = step.apply(df, source)
        if not step.keeps_values:
            stats, filled = None, set()
        elif stats is not None:
            filled = _carried(df.columns, after.columns, filled, step)
            stats = step.apply(stats)
        df = after
    return laid, df, ()


def _run_of_fills(steps: Sequence[Step], filled: set[str]) -> list[FillNulls]:
    """The fills that the steps begin with, up to one of a column that is filled by then."""
    run: list[FillNulls] = []
    for step in steps:
        if not isinstance(step, FillNulls) or step.column in filled | {s.column for s in run}:
            break
        run.append(step)
    return run


def _by_run(laid: Sequence[Stage]) -> Iterator[list[Stage]]:
    """Fills that were laid together, and all other stages by themselves."""
    run: list[Stage] = []
    for stage in laid:
        together = run and all(isinstance(s.step, FillNulls) for s in (run[-1], stage))
        if run and not (together and run[-1].frame is stage.frame):
            yield run
            run = []
        run.append(stage)
    if run:
        yield run


def _apply(df: DataFrame, run: Sequence[Stage]) -> DataFrame:
    """A run of ``_by_run`` applied to a frame with the columns of the one it was laid on."""
    if isinstance(run[0].step, FillNulls):
        return apply_fills(df, [s.step for s in run], run[0].stats)
    return run[0].step.apply(df, run[0].stats)


def _carried(before: list[str], after: list[str], names: set[str], step: Step) -> set[str]:
    """The names under which columns go on after a rename or drop."""
    if len(before) == len(after):
        return {new for old, new in zip(before, after) if old in names}
    return names & set(after)


def apply_steps(
    df: DataFrame,
    steps: Sequence[Step],
    stats: DataFrame | None = None,
    checkpoint: bool = False,
) -> DataFrame:
    """Apply the steps in order, as one lazy plan.

    With ``checkpoint``, the result ahead of each further run of fills (see
    ``stages``) is written to the shared folder and read back, which pays off
    when the steps before it are expensive; each statistic computes them anew
    otherwise. ``stats`` is a batch table to take all statistics from, for a
    stream: every step is applied to it too, so a statistic leaves out the same
    rows as in a batch.
    """
    if stats is not None:
        return reduce(_apply, _by_run(stages(stats, steps)[0]), df)
    while True:
        _, df, steps = stages(df, steps, checkpoint)
        if not steps:
            return df
        path = new_path(df.sparkSession, "stage")
        df.write.parquet(path)
        df = _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class StepRecord:
    seq: int
    step: str
    status: str
    reason: str | None
    initial_rows: int
    initial_columns: int
    final_rows: int
    final_columns: int
    details: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class StepReport:
    records: tuple[StepRecord, ...]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(vars(r).values()) for r in self.records]
        return spark.createDataFrame(rows, REPORT_SCHEMA)

    @property
    def rows_removed(self) -> int:
        if not self.records:
            return 0
        return self.records[0].initial_rows - self.records[-1].final_rows


def write_nothing(df: DataFrame) -> None:
    """A sink that computes the result and drops it."""
    df.write.format("noop").mode("overwrite").save()


def run_steps(
    df: DataFrame,
    steps: Sequence[Step],
    sink: Callable[[DataFrame], None] = write_nothing,
    checkpoint: bool = False,
    ready: Callable[[DataFrame], None] | None = None,
) -> StepReport:
    """Apply the steps, pass the result to ``sink`` and report on each step.

    ``sink`` must compute the whole frame, as any write does. ``ready`` gets the
    result before that and may raise.

    The report's counts are taken while the sink's job runs, wherever that is
    exact: an observation ahead of a shuffle may count a task twice if an
    executor is lost and the task is repeated. Counts ahead of a shuffle are
    therefore taken by aggregates, in one job ahead of the sink's: one for all
    steps between two shuffles, over rows that carry how many of the filters
    they have passed.
    """
    records: list[StepRecord] = []
    written: list[str] = []
    while True:
        laid, last, steps = stages(df, steps, checkpoint)
        if not steps:
            if ready:
                ready(last)
            records += _run_stages(laid, last, sink, len(records))
            for path in written:
                delete_path(df.sparkSession, path)
            return StepReport(tuple(records))
        path = new_path(df.sparkSession, "stage")
        written.append(path)
        records += _run_stages(laid, last, lambda out: out.write.parquet(path), len(records))
        df = _written(last, path)


def _run_stages(
    laid: Sequence[Stage], last: DataFrame, sink: Callable[[DataFrame], None], done: int
) -> list[StepRecord]:
    spark = last.sparkSession
    frames = [stage.frame for stage in laid] + [last]
    taken_at = _where_counted(laid)
    wanted = _wanted(laid, frames, taken_at)
    ahead = [any(s.step.shuffles for s in laid[i:]) for i in range(len(frames))]
    found = _count_now(spark, laid, frames, {i: w for i, w in enumerate(wanted) if w and ahead[i]})

    observations: dict[int, Observation] = {}

    def observed(df: DataFrame, i: int) -> DataFrame:
        if not wanted[i] or ahead[i]:
            return df
        observations[i] = Observation(f"after step {i}")
        return df.observe(observations[i], *(c.alias(n) for n, c in wanted[i].aggregates().items()))

    df, i = frames[0], 0
    for run in _by_run(laid):
        df = _apply(observed(df, i), run)
        i += len(run)
    sink(observed(df, i))
    lost = {}
    for i, observation in observations.items():
        try:
            found[i] = observation.get
        except Py4JJavaError:
            # The optimizer saw that nothing gets this far and left it out.
            lost[i] = wanted[i]
    found.update(_count_now(spark, laid, frames, lost))
    return list(_records(laid, frames, taken_at, wanted, found, done))


@dataclass
class Wanted:
    """What to take of a frame: whether its rows, conditions to count, other
    aggregates, scalars that go with them, and which field of the medians is whose."""

    rows: bool = False
    counts: dict[str, Column] = field(default_factory=dict)
    others: dict[str, Column] = field(default_factory=dict)
    scalars: dict[str, Column] = field(default_factory=dict)
    medians: dict[int, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.rows or bool(self.counts or self.others or self.scalars)

    def aggregates(self) -> dict[str, Column]:
        """All of it as aggregates over the frame."""
        return {
            **({"rows": F.count(F.lit(1))} if self.rows else {}),
            **{n: F.count_if(c) for n, c in self.counts.items()},
            **self.others,
            **{n: F.first(c) for n, c in self.scalars.items()},
        }


def _where_counted(laid: Sequence[Stage]) -> list[int]:
    """For each step, ahead of which step its metrics are taken.

    Fills that share their statistics are counted together, ahead of the first:
    filling one column does not change what is missing in another.
    """
    at: list[int] = []
    for run in _by_run(laid):
        at += [len(at)] * len(run)
    return at


def _wanted(
    laid: Sequence[Stage], frames: Sequence[DataFrame], taken_at: Sequence[int]
) -> list[Wanted]:
    """What to take ahead of each step, and after the last."""
    wanted = [Wanted(i == 0 or laid[i - 1].step.changes_rows) for i in range(len(frames))]
    i = 0
    for run in _by_run(laid):
        at, frame = wanted[taken_at[i]], run[0].frame
        acting = [(i + k, s.step) for k, s in enumerate(run) if not s.step.skip_reason(frame)]
        for k, step in acting:
            at.counts |= {f"{n}_{k}": c for n, c in step.counts(frame).items()}
            at.others |= {f"{n}_{k}": c for n, c in step.metrics(frame, run[0].stats).items()}
        fills = [(k, step) for k, step in acting if isinstance(step, FillNulls)]
        if fills:
            scalars, medians = _statistics(fills, run[0].stats)
            at.scalars |= scalars
            at.medians |= medians
        i += len(run)
    return wanted


def _statistics(
    fills: Sequence[tuple[int, FillNulls]], source: DataFrame
) -> tuple[dict[str, Column], dict[int, str]]:
    """What the fills fill in, as scalars. Medians are one scalar, with the field for each fill."""
    medians, fields = medians_for([step for _, step in fills], source)
    out = {} if medians is None else {MEDIANS: medians}
    of = {}
    for (k, step), name in zip(fills, fields, strict=True):
        if name:
            of[k] = name
            continue
        statistic = step.statistic(source)
        if statistic is not None:
            out[f"{STATISTIC}_{k}"] = statistic
    return out, of


def _count_now(
    spark: SparkSession,
    laid: Sequence[Stage],
    frames: Sequence[DataFrame],
    wanted: Mapping[int, Wanted],
) -> dict[int, Mapping[str, object]]:
    """Take what is wanted of several frames in one job.

    Frames between which rows are only filtered, filled and renamed are counted
    together, by one aggregate over the first of them.
    """
    if not wanted:
        return {}
    cells = []
    for first, last in _spans(laid, frames, sorted(wanted)):
        row = _counts_of_span(laid, frames, wanted, first, last)
        cells.append(row.select(F.struct(*row.columns)).scalar().alias(f"span_{first}"))
    for i, w in wanted.items():
        if w.others:
            row = frames[i].agg(*(c.alias(n) for n, c in w.others.items()))
            cells.append(row.select(F.struct(*row.columns)).scalar().alias(f"others_{i}"))
        cells += [c.alias(f"scalar_{i}_{n}") for n, c in w.scalars.items()]
    row = spark.range(1).select(*cells).first().asDict()
    found: dict[int, dict[str, object]] = {i: {} for i in wanted}
    for i, w in wanted.items():
        if w.others:
            found[i] |= row[f"others_{i}"].asDict()
        found[i] |= {n: row[f"scalar_{i}_{n}"] for n in w.scalars}
    for name, counts in row.items():
        if name.startswith("span_"):
            for cell, value in counts.asDict().items():
                i, _, n = cell.partition("_")
                found[int(i)][n] = value
    return found


def _spans(
    laid: Sequence[Stage], frames: Sequence[DataFrame], wanted: Sequence[int]
) -> Iterator[tuple[int, int]]:
    """First and last number of the frames that can be counted together."""
    first = last = wanted[0]
    for i in wanted[1:]:
        if not all(_can_be_marked(laid[k]) for k in range(last, i)):
            yield first, last
            first = i
        last = i
    yield first, last


def _can_be_marked(stage: Stage) -> bool:
    """Whether the step's filter is known, or it keeps all rows and no more is known to matter."""
    step = stage.step
    if isinstance(step, FillNulls) or step.keeps_values:
        return True
    return not step.shuffles and step.condition(stage.frame) is not None


def _counts_of_span(
    laid: Sequence[Stage],
    frames: Sequence[DataFrame],
    wanted: Mapping[int, Wanted],
    first: int,
    last: int,
) -> DataFrame:
    """One row: what is wanted of the frames from the first to the last.

    Filters take no rows away here. Instead a row carries how many of them it has
    passed, and what is counted along the way, which is summed at the end.
    """
    prefix = "_counted"
    while any(n.lower().startswith(prefix) for f in frames[first : last + 1] for n in f.columns):
        prefix += "_"
    flag, passed, sums = f"{prefix}flag", 0, {}
    marked = frames[first].select("*", F.lit(0).alias(flag))
    i = first
    while True:
        here = F.col(flag) == passed
        w = wanted.get(i)
        if w:
            kept = {**({"rows": F.lit(True)} if w.rows else {}), **w.counts}
            cells = [(here & c).alias(f"{prefix}{i}_{n}") for n, c in kept.items()]
            marked = marked.select("*", *cells)
            sums |= {f"{i}_{n}": F.count_if(F.col(f"{prefix}{i}_{n}")) for n in kept}
        if i == last:
            return marked.agg(*(c.alias(n) for n, c in sums.items()))
        run = next(_by_run(laid[i:last]))
        step, frame = run[0].step, run[0].frame
        own = [n for n in marked.columns if n.startswith(prefix)]
        if isinstance(step, FillNulls):
            marked = _apply(marked, run)
        elif step.keeps_values:
            after = step.apply(frame).columns
            before = frame.columns if len(after) == len(frame.columns) else after
            renamed = [qcol(old).alias(new) for old, new in zip(before, after, strict=True)]
            marked = marked.select(*renamed, *own)
        else:
            on = F.when(here & step.condition(frame), passed + 1).otherwise(F.col(flag))
            marked = marked.withColumn(flag, on)
            passed += 1
        i += len(run)


def _records(
    laid: Sequence[Stage],
    frames: Sequence[DataFrame],
    taken_at: Sequence[int],
    wanted: Sequence[Wanted],
    found: Mapping[int, Mapping[str, object]],
    done: int,
) -> Iterator[StepRecord]:
    rows = found[0]["rows"]
    for i, stage in enumerate(laid):
        counts = found.get(taken_at[i], {})
        suffix = f"_{i}"
        metrics = {k.removesuffix(suffix): v for k, v in counts.items() if k.endswith(suffix)}
        median = wanted[taken_at[i]].medians.get(i)
        if median:
            metrics[STATISTIC] = counts[MEDIANS][median]
        after = found.get(i + 1, {}).get("rows", rows)
        reason = stage.step.skip_reason(stage.frame) or stage.step.data_skip_reason(metrics)
        yield StepRecord(
            seq=done + i + 1,
            step=stage.step.title,
            status=SKIPPED if reason else APPLIED,
            reason=reason,
            initial_rows=rows,
            initial_columns=len(stage.frame.columns),
            final_rows=after,
            final_columns=len(frames[i + 1].columns),
            details={} if reason else stage.step.details(stage.frame, metrics),
        )
        rows = after


# --- specs ----------------------------------------------------------------

# The lists of a spec that hold steps, in the order they run.
STEP_LISTS = ("cleaning_steps", "transformations")


def _find_lists(node: object, found: dict[str, list]) -> dict[str, list]:
    if isinstance(node, Mapping):
        for key, child in node.items():
            if key in STEP_LISTS and isinstance(child, list):
                found[key] = child
            else:
                _find_lists(child, found)
    return found


def steps_from_spec(spec: str | Mapping | list) -> list[Step]:
    """Read steps from JSON, bare or inside the envelope."""
    data = json.loads(spec) if isinstance(spec, str) else spec
    if isinstance(data, list):
        return [step_from_dict(e) for e in data]
    lists = _find_lists(data, {})
    if not lists:
        raise ValueError(f"none of {', '.join(STEP_LISTS)} found")
    return [step_from_dict(e) for name in STEP_LISTS for e in lists.get(name, [])]


def envelope(
    component: str, config: Mapping, pipeline_name: str = "", execution_method: str = "Spark"
) -> dict:
    """The file form of one component's settings."""
    return {
        "pipeline_name": pipeline_name,
        "execution_method": execution_method,
        f"{component}_config": dict(config),
    }


def spec_from_steps(steps: Sequence[Step], pipeline_name: str = "") -> str:
    config = {"cleaning_steps": steps_to_dicts(steps)}
    return json.dumps(envelope("cleaning", config, pipeline_name))


# --- branches -------------------------------------------------------------


@dataclass(frozen=True)
class Branches:
    """A source with its rules, and the three frames one can go on with."""

    source: DataFrame
    rules: tuple[Rule, ...] = ()

    def branch(self, name: str) -> DataFrame:
        if name == "source":
            return self.source
        if name == "clean":
            return clean_rows(self.source, self.rules)
        if name == "error":
            return error_rows(self.source, self.rules)
        raise ValueError(f"branch must be source, clean or error, not {name!r}")

    def cleaned(self, name: str, steps: Sequence[Step]) -> DataFrame:
        return apply_steps(self.branch(name), steps)

    def repaired(self, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
        """The clean rows with those error rows that the steps repair, and those that stay errors.

        The steps are applied to the error rows alone, which then meet the rules once
        more. Statistics of fills come from the source, as error rows may lack what is
        asked for. The steps may not change the columns. Types widen as the fills need
        it. No row is lost but those that the steps themselves remove.
        """
        clean = self.branch("clean")
        mended = apply_steps(self.branch("error"), steps, stats=self.source)
        if mended.columns != self.source.columns:
            raise ValueError("steps that repair rows cannot change the columns")
        return clean.unionByName(clean_rows(mended, self.rules)), error_rows(mended, self.rules)


# --- table to table -------------------------------------------------------


def remove_nulls_from_table(
    spark: SparkSession,
    input_table: str,
    output_table: str,
    columns_to_check: Sequence[str] | str | None = None,
    how: str = "any",
    fmt: str = DEFAULT_FORMAT,
    path: str | None = None,
) -> StepReport:
    """Read a table, drop rows with missing values and write another table.

    Reading, both counts and writing are one job. The columns may be given as
    JSON text; text that is no JSON list means all columns.
    """
    if input_table == output_table:
        raise ValueError(f"{input_table} cannot be both input and output")
    columns = read_list(columns_to_check)
    step = (
        RemoveNulls(DROP_ROWS_COL, tuple(columns), how=how)
        if columns
        else RemoveNulls(DROP_ROWS_ANY, how=how)
    )
    return run_steps(
        spark.table(input_table),
        [step],
        lambda df: write_table(df, output_table, fmt, path=path),
    )


# Names of the settings of a null-removal job.
INPUT_DATABASE = "input_lakehouse_name"
INPUT_TABLE = "input_table_name"
OUTPUT_DATABASE = "output_lakehouse_name"
OUTPUT_TABLE = "output_table_name"
COLUMNS_TO_CHECK = "columns_to_check"
HOW_TO_DROP = "how_to_drop"


def remove_nulls_from_params(spark: SparkSession, params: Mapping[str, object]) -> StepReport:
    """``remove_nulls_from_table`` with its settings given by name."""
    return remove_nulls_from_table(
        spark,
        f"{params[INPUT_DATABASE]}.{params[INPUT_TABLE]}",
        f"{params[OUTPUT_DATABASE]}.{params[OUTPUT_TABLE]}",
        params.get(COLUMNS_TO_CHECK),
        str(params.get(HOW_TO_DROP, "any")),
    )
