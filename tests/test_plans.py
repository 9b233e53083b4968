"""Steps, their report, specs, branches and the lineage log."""

import json

import pytest
from pyspark.sql import functions as F

from sparkprep import fixtures as fx
from sparkprep.functions.ordered import range_bounds, with_predecessor
from sparkprep.operators.fill import fill_mean
from sparkprep.operators.validate import NotNull
from sparkprep.plans import cleaning, job, lineage
from sparkprep.plans import steps as s
from sparkprep.session import new_path
from sparkprep.sources import sinks

FOLDER = "/root/testdata/sf0.001"


def multiset(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def small(spark):
    rows = [(1, None, "x", 5), (2, 2.0, None, 5), (2, 2.0, None, 5), (None, 4.0, "x", 5)]
    return spark.createDataFrame(rows, "id int, v double, t string, full int")


ALL_STEPS = [
    s.FillNulls("v", "fill_mean"),
    s.FillNulls("v", "fill_median", approx=True),
    s.FillNulls("t", "fill_mode"),
    s.FillNulls("t", "fill_specific", "UNKNOWN", only_if_nulls=False),
    s.FillNulls("v", "fill_specific", 1.5),
    s.RemoveNulls("drop_rows_any"),
    s.RemoveNulls("drop_rows_col", ("id", "v"), how="all"),
    s.RemoveNulls("drop_column", column_to_drop="t"),
    s.RenameColumns("specific_rename", "id", "key"),
    s.RenameColumns("to_uppercase", columns_to_transform=("id",)),
    s.RenameColumns("to_camel_case", columns_to_transform="*"),
    s.DropColumns(("t", "absent")),
    s.RemoveDuplicates(),
    s.FilterEquals("id", "2"),
    s.RemoveColumn(("t",)),
]


@pytest.mark.parametrize("step", ALL_STEPS, ids=lambda x: x.title)
def test_steps_survive_json_and_typed_params(small, step):
    again = cleaning.steps_from_spec(cleaning.spec_from_steps([step]))
    assert again == [step]
    assert s.step_from_typed_params(step.type, step.typed_params()) == step
    assert multiset(step(small)) == multiset(again[0](small))


@pytest.mark.parametrize("step", ALL_STEPS, ids=lambda x: x.title)
def test_every_step_twice_is_the_same_as_once(small, step):
    once = step(small)
    assert multiset(step(once)) == multiset(once)


@pytest.mark.parametrize(
    "build",
    [
        lambda: s.FillNulls("", "fill_mean"),
        lambda: s.FillNulls("v", "fill_guess"),
        lambda: s.RemoveNulls("drop_rows_col"),
        lambda: s.RemoveNulls("drop_column"),
        lambda: s.RemoveNulls("drop"),
        lambda: s.RemoveNulls("drop_rows_any", how="some"),
        lambda: s.RenameColumns("specific_rename", "a"),
        lambda: s.RenameColumns("to_lowercase"),
        lambda: s.RenameColumns("to_title", columns_to_transform="*"),
        lambda: s.DropColumns(()),
        lambda: s.FilterEquals("", "x"),
        lambda: s.step_from_dict({"type": "unheard_of"}),
        lambda: cleaning.steps_from_spec({"a": 1}),
    ],
)
def test_incomplete_steps_are_rejected(build):
    with pytest.raises(ValueError):
        build()


def test_lists_in_parameters():
    assert s.read_list('["a"]') == ["a"]
    assert s.read_list("not json") is None
    assert s.read_list('"a"') is None
    assert s.read_list(["a"]) == ["a"]
    assert s.read_list(None) is None


def test_spec_in_its_envelope():
    spec = {
        "pipeline_name": "p",
        "execution_method": "x",
        "cleaning_config": {"cleaning_steps": [{"type": "remove_duplicates"}]},
        "transformations": [
            {"type": "Filter", "column": "a", "value": "1"},
            {"type": "Remove Column", "columns": ["b"]},
        ],
    }
    found = cleaning.steps_from_spec(json.dumps(spec))
    assert found == [s.RemoveDuplicates(), s.FilterEquals("a", "1"), s.RemoveColumn(("b",))]


def test_report_counts_and_reasons(spark, small):
    plan = [
        s.FillNulls("absent", "fill_mean"),
        s.FillNulls("t", "fill_mean"),
        s.FillNulls("full", "fill_mean"),
        s.FillNulls("v", "fill_specific"),
        s.FillNulls("v", "fill_mean"),
        s.FillNulls("t", "fill_mode"),
        s.RemoveNulls("drop_rows_col", ("absent",)),
        s.RemoveNulls("drop_rows_col", ("id",)),
        s.RenameColumns("specific_rename", "absent", "x"),
        s.RenameColumns("to_uppercase", columns_to_transform="*"),
        s.RemoveNulls("drop_column", column_to_drop="V"),
        s.DropColumns(("FULL", "absent")),
        s.RemoveDuplicates(),
    ]
    written = []
    report = cleaning.run_steps(small, plan, lambda df: written.append(df.collect()))
    records = report.records
    assert [r.reason for r in records] == [
        "Column 'absent' not found.",
        "Cannot fill mean for non-numeric column 't'.",
        "Column 'full' has no null values.",
        "Fill value not provided for specific fill strategy.",
        None,
        None,
        "No valid columns for drop_rows_col.",
        None,
        "Column 'absent' not found for specific rename.",
        None,
        "Column 'V' has no nulls.",
        None,
        None,
    ]
    assert [r.final_rows for r in records] == [4, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3, 3, 2]
    assert records[-1].final_columns == 3 and records[0].initial_columns == 4
    assert records[4].details["filled_value_actual"] == str(8 / 3)
    assert records[4].details["filled"] == "1"
    assert records[5].details["filled_value_actual"] == "x"
    assert records[11].details == {"columns_dropped": "FULL", "columns_not_found": "absent"}
    assert report.rows_removed == 2
    assert len(written) == 1 and len(written[0]) == 2
    assert report.to_frame(spark).count() == len(plan)


@pytest.mark.parametrize(
    "plan, rows",
    [
        ([s.FilterEquals("id", "x"), s.FillNulls("v", "fill_mean")], (4, 0, 0)),
        ([s.FilterEquals("id", "x"), s.FilterEquals("id", "1")], (4, 0, 0)),
        ([s.Custom(lambda df: df.limit(0), "none", shuffles=False)], (4, 0)),
    ],
)
def test_report_where_nothing_is_left(small, plan, rows):
    records = cleaning.run_steps(small, plan).records
    assert (records[0].initial_rows, *[r.final_rows for r in records]) == rows


def test_counts_of_adjacent_fills_are_taken_together(small):
    plan = [
        s.FillNulls("v", "fill_mean"),
        s.FillNulls("t", "fill_mode"),
        s.FillNulls("id", "fill_specific", 0),
        s.FillNulls("v", "fill_specific", 0),
    ]
    seen = []
    report = cleaning.run_steps(
        small, plan, lambda df: (seen.append(plan_text(df)), cleaning.write_nothing(df))
    )
    assert seen[0].count("CollectMetrics") == 2
    assert [r.details.get("filled") for r in report.records] == ["1", "2", "1", None]
    assert report.records[3].reason == "Column 'v' has no null values."


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_null_removal_is_one_job(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    spark.sparkContext.setJobGroup("removal", "removal")
    cleaning.run_steps(orders, [s.RemoveNulls("drop_rows_any")])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("removal")) == 1
    spark.sparkContext.setJobGroup("other", "other")


def test_report_of_no_steps(small):
    assert cleaning.run_steps(small, []).records == ()


def test_mode_that_cannot_be_found(spark):
    df = spark.createDataFrame([(None,)], "t string")
    record = cleaning.run_steps(df, [s.FillNulls("t", "fill_mode")]).records[0]
    assert record.reason == "Could not determine mode for column 't'."


def test_result_is_the_same_with_report_and_checkpoint(spark):
    df = fx.dup_events(spark, FOLDER)
    plan = [
        s.FillNulls("event_type", "fill_mode"),
        s.RenameColumns("to_camel_case", columns_to_transform="*"),
        s.FillNulls("value", "fill_median"),
        s.RemoveNulls("drop_rows_any"),
        s.FillNulls("value", "fill_mean"),
        s.RemoveDuplicates(),
        s.FillNulls("userId", "fill_mean"),
    ]
    one_by_one = df
    for step in plan:
        one_by_one = step(one_by_one)
    seen = []
    cleaning.run_steps(df, plan, lambda d: seen.append(multiset(d)))
    wanted = multiset(one_by_one)
    assert seen == [wanted]
    for checkpoint in (True, False):
        assert multiset(cleaning.apply_steps(df, plan, checkpoint=checkpoint)) == wanted
    plain, cut = (cleaning.run_steps(df, plan, checkpoint=c).records for c in (False, True))
    assert [vars(r) for r in plain] == [vars(r) for r in cut]
    assert [r.seq for r in cut] == list(range(1, len(plan) + 1))


def test_where_plans_are_cut(spark):
    df = fx.dirty_lineitem(spark, FOLDER).withColumnRenamed("l_linestatus", " a.b ")
    fill, drop = s.FillNulls("l_quantity", "fill_mean"), s.RemoveNulls("drop_rows_any")
    plan = [fill, drop] * 4
    left = {c: len(cleaning.stages(df, plan, c)[2]) for c in (True, False)}
    assert left == {True: 6, False: 0}
    cut = cleaning.apply_steps(df, plan, checkpoint=True)
    assert cut.columns == df.columns and "stage" in plan_text_files(cut)


def plan_text_files(df):
    return " ".join(df.inputFiles())


def test_second_fill_of_a_column_sees_the_first(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    plan = [s.FillNulls("v", "fill_specific", 5), s.FillNulls("v", "fill_mean")]
    assert sorted(r[0] for r in cleaning.apply_steps(df, plan).collect()) == [1.0, 3.0, 5.0]
    laid, _, left = cleaning.stages(df, plan)
    assert not left
    assert laid[0].stats is df and laid[1].stats is not df


def test_many_fills_stay_one_flat_plan(spark):
    lineitem = fx.dirty_lineitem(spark, FOLDER)
    names = ["l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber"]
    plan = [s.FillNulls(n, "fill_mean") for n in names]
    text = cleaning.apply_steps(lineitem, plan)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [named_struct") <= len(names)
    assert text.count("Join") == 0


def explained(df):
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(execution, "simple")


def test_a_plan_reads_its_source_a_few_times(spark):
    from sparkprep.queries import QUERIES

    # The source is two scans, and is read for the rows, three times for the median, twice for the mode.
    assert explained(QUERIES["clean_steps"](spark, FOLDER)).count("FileScan") == 12


def test_counts_of_steps_between_shuffles_are_one_aggregate(spark):
    df = fx.dup_events(spark, FOLDER)
    plan = [
        s.RemoveNulls("drop_rows_col", ("user_id",)),
        s.FillNulls("event_type", "fill_mode"),
        s.RenameColumns("to_uppercase", columns_to_transform="*"),
        s.FilterEquals("EVENT_TYPE", "signup"),
        s.FillNulls("VALUE", "fill_specific", 0),
        s.DropColumns(("TS",)),
        s.RemoveNulls("drop_rows_any", how="all"),
        s.RemoveDuplicates(),
        s.RemoveNulls("drop_rows_col", ("USER_ID",)),
        s.RemoveDuplicates(),
        s.FilterEquals("USER_ID", "3"),
    ]
    laid, last, _ = cleaning.stages(df, plan)
    frames = [stage.frame for stage in laid] + [last]
    assert list(cleaning._spans(laid, frames, range(8))) == [(0, 7)]
    assert list(cleaning._spans(laid, frames, range(11))) == [(0, 7), (8, 9), (10, 10)]
    records = cleaning.run_steps(df, plan).records
    counts = [f.count() for f in frames]
    assert [(r.initial_rows, r.final_rows) for r in records] == list(zip(counts, counts[1:]))
    assert [r.initial_columns for r in records] == [len(f.columns) for f in frames[:-1]]
    missing = laid[1].frame.where("event_type IS NULL").count()
    assert records[1].details["filled"] == str(missing) and missing > 0
    assert records[4].details["filled"] == str(laid[4].frame.where("VALUE IS NULL").count())


def test_names_like_those_of_the_counts(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0), (3, 4.0)], "_countedflag int, _counted0_rows double")
    plan = [s.FillNulls("_counted0_rows", "fill_median"), s.RemoveNulls("drop_rows_any"), s.RemoveDuplicates()]
    records = cleaning.run_steps(df, plan).records
    assert [(r.initial_rows, r.final_rows) for r in records] == [(3, 3), (3, 2), (2, 2)]
    assert records[0].details["filled_value_actual"] == "3.0"


def test_custom_steps_are_counted_by_themselves(spark):
    df = spark.range(20).toDF("a")
    plan = [s.Custom(lambda d: d.where("a < 10"), "less"), s.RemoveDuplicates(), s.FilterEquals("a", "3")]
    records = cleaning.run_steps(df, plan).records
    assert [(r.initial_rows, r.final_rows) for r in records] == [(20, 10), (10, 10), (10, 1)]


def test_steps_run_no_job_while_being_applied(spark, small):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    plan = [
        s.FillNulls("v", "fill_median"),
        s.FillNulls("t", "fill_mode"),
        s.RemoveNulls("drop_rows_any"),
        s.RenameColumns("to_uppercase", columns_to_transform="*"),
        s.FillNulls("ID", "fill_mean"),
        s.RemoveDuplicates(),
    ]
    cleaning.apply_steps(small, plan)
    assert tracker.getJobIdsForGroup("lazy") == []
    spark.sparkContext.setJobGroup("other", "other")


def test_custom_steps(small):
    s.register_function(
        "keep_first_letter", lambda df, column: df.withColumn(column, F.left(column, F.lit(1)))
    )
    found = cleaning.steps_from_spec([{"type": "keep_first_letter", "column": "t"}])
    assert found[0](small).where("t = 'x'").count() == 2
    assert found[0].to_dict() == {"type": "keep_first_letter", "column": "t"}
    inline = s.Custom(lambda df: df.limit(1))
    assert cleaning.run_steps(small, [inline]).records[0].final_rows == 1
    with pytest.raises(TypeError):
        inline.to_dict()


def test_branches(small):
    branches = cleaning.Branches(small, (NotNull("v"), NotNull("t")))
    assert branches.branch("source").count() == 4
    assert branches.branch("clean").count() == 1
    fixed = branches.cleaned("error", [s.FillNulls("t", "fill_specific", "U")])
    assert fixed.where("t = 'U'").count() == 2
    with pytest.raises(ValueError):
        branches.branch("both")


def test_null_removal_between_tables(spark, small):
    spark.sql("CREATE DATABASE IF NOT EXISTS prep")
    sinks.write_table(small, "prep.dirty")
    params = {
        "input_lakehouse_name": "prep",
        "input_table_name": "dirty",
        "output_lakehouse_name": "prep",
        "output_table_name": "tidy",
        "columns_to_check": '["t"]',
        "how_to_drop": "any",
    }
    report = cleaning.remove_nulls_from_params(spark, params)
    assert (report.records[0].initial_rows, report.records[0].final_rows) == (4, 2)
    assert spark.table("prep.tidy").count() == 2
    cleaning.remove_nulls_from_params(spark, {**params, "columns_to_check": "not json"})
    assert spark.table("prep.tidy").count() == 0
    with pytest.raises(ValueError):
        cleaning.remove_nulls_from_table(spark, "prep.dirty", "prep.dirty")


def test_log_is_numbered_on(spark):
    path = new_path(spark, "log")
    assert lineage.read_log(spark, path).count() == 0
    lineage.append(spark, path, "r1", [("load", {"rows": 3, "skipped": None}), ("clean", {})])
    lineage.append(spark, path, "r2", [("load", {"rows": 1})])
    lineage.append(spark, path, "r1", [("save", {"table": "None", "mode": "overwrite"})])
    log = lineage.read_log(spark, path)
    seqs = [r["seq"] for r in log.where("run_id = 'r1'").orderBy("seq").collect()]
    assert seqs == [0, 1, 2]
    edges = [tuple(r) for r in lineage.edges(log).orderBy("current").collect()]
    assert edges == [("r1", 0, 1), ("r1", 1, 2)]
    labels = {(r["run_id"], r["seq"]): r["label"] for r in lineage.labels(log).collect()}
    assert labels["r1", 0] == "Step 1: load\n(rows: 3)"
    assert labels["r1", 1] == "Step 2: clean"
    assert labels["r1", 2] == "Step 3: save\n(mode: overwrite)"
    assert labels["r2", 0] == "Step 1: load\n(rows: 1)"


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_predecessors_across_ranges(spark, chunk):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("g"),
        (F.col("id") * F.col("id") - 50).alias("o"),
    )
    found = with_predecessor(df, "g", "o", chunk=chunk)
    df.createOrReplaceTempView("plain")
    wanted = spark.sql(
        "SELECT g, o, lag(o) OVER (PARTITION BY g ORDER BY o) AS previous,"
        " CAST(row_number() OVER (PARTITION BY g ORDER BY o) AS BIGINT) AS position FROM plain"
    )
    assert multiset(found) == multiset(wanted)
    assert "Join" not in plan_text(found)


def test_statistics_from_another_table(spark):
    df = spark.createDataFrame([(None,)], "v double")
    other = spark.createDataFrame([(2.0,), (4.0,)], "v double")
    assert fill_mean(df, "v", stats=other).first()["v"] == 3.0
    plan = [s.RenameColumns("specific_rename", "v", "w"), s.FillNulls("w", "fill_mean")]
    assert cleaning.apply_steps(df, plan, stats=other).first()["w"] == 3.0


def test_job_from_files_to_table(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("id;v\n1;2.5\n2;NA\n2;NA\nx;1\n")
    spec = {
        "pipeline_name": "files",
        "source": {"path": str(path), "format": "CSV", "header": True, "delimiter": ";"},
        "validation_config": {
            "suite": {
                "expectations": [
                    {
                        "expectation_type": "expect_column_values_to_be_of_type",
                        "kwargs": {"column": "id", "type": "int"},
                    }
                ]
            }
        },
        "split_path": new_path(spark, "split"),
        "cleaning_config": {
            "cleaning_steps": [
                {"type": "fill_null_data", "column": "v", "strategy": "fill_mean"},
                {"type": "remove_duplicates"},
            ]
        },
        "transformations": [{"type": "Remove Column", "columns": ["id"]}],
        "output_table": "prepared_files",
        "lineage_path": new_path(spark, "log"),
    }
    result = job.run_job(spark, json.dumps(spec))
    assert sorted(r["v"] for r in spark.table("prepared_files").collect()) == [2.5, 2.5]
    assert result.report.rows_removed == 1
    assert result.validation.first()["unexpected_count"] == 1
    clean, error = sinks.read_split(spark, spec["split_path"])
    assert (clean.count(), error.count()) == (3, 1)
    names = lineage.read_log(spark, spec["lineage_path"]).orderBy("seq").select("name").collect()
    assert [r["name"].split("(")[0] for r in names] == [
        "Source",
        "Validation",
        "fill_null_data",
        "remove_duplicates",
        "Remove Column",
        "Load",
    ]


@pytest.mark.parametrize(
    "spec",
    [
        {"output_table": "t"},
        {"source": {}, "output_table": "t"},
        {"source": {"table": "t"}},
        {"source": {"table": "t"}, "output_table": "t"},
    ],
)
def test_incomplete_jobs_are_rejected(spec):
    with pytest.raises(ValueError):
        job.job_from_spec(spec)


def test_statistics_of_a_stream_leave_out_filtered_rows(spark):
    batch = spark.createDataFrame([(1, 2.0), (1, None), (None, 100.0)], "u int, v double")
    plan = [s.RemoveNulls("drop_rows_col", ("u",)), s.FillNulls("v", "fill_mean")]
    wanted = multiset(cleaning.apply_steps(batch, plan))
    assert multiset(cleaning.apply_steps(batch, plan, stats=batch)) == wanted


def test_duplicates_in_a_stream_need_a_delay(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="delay"):
        s.RemoveDuplicates().apply(stream)
    assert s.RemoveDuplicates("timestamp", "1 hour").apply(stream).isStreaming


def test_column_drops_share_one_look_at_the_data(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, 3.0), (2, "x", float("nan"))], "a int, b string, c double")
    monkeypatch.setattr(s, "contains_missing", None)
    plan = [s.RemoveNulls("drop_column", column_to_drop=n) for n in ("a", "b", "c", "b", "z")]
    records = cleaning.run_steps(df, plan).records
    assert [r.status for r in records] == ["skipped", "applied", "applied", "skipped", "skipped"]
    assert cleaning.apply_steps(df, plan).columns == ["a"]


@pytest.mark.parametrize("spacing", [1, 1_000_000])
def test_ranges_follow_the_rows_and_not_their_spacing(spark, spacing):
    df = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") * spacing).alias("o"))
    bounds = range_bounds(df, "o", chunk=100)
    assert 8 <= len(bounds) <= 10
    found = {r.o: r for r in with_predecessor(df, "g", "o", chunk=100).collect()}
    for i in range(1000):
        before = (i - 1) * spacing if i else None
        assert (found[i * spacing].previous, found[i * spacing].position) == (before, i + 1)


def test_repaired_rows_join_the_clean_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (None, None), (3, "")], "n int, t string")
    branches = cleaning.Branches(df, (NotNull("n"), NotNull("t")))
    good, bad = branches.repaired([s.FillNulls("t", "fill_specific", "x")])
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, "x"), (3, "")]
    assert sorted(map(tuple, bad.collect()), key=str) == [(None, "b"), (None, "x")]
    good, bad = branches.repaired([s.FillNulls("n", "fill_mean"), s.RemoveNulls("drop_rows_any")])
    assert sorted(map(tuple, good.collect())) == [(1.0, "a"), (2.0, "b"), (3.0, "")]
    assert bad.count() == 0
    with pytest.raises(ValueError, match="columns"):
        branches.repaired([s.DropColumns(("t",))])
