"""Profiles of streams, files loaded once, and logs with several writers."""

import random
import statistics
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import profile
from sparkprep.plans import lineage
from sparkprep.sources import ledger, replace
from sparkprep.streaming import ingest

# --- profiles of streams ---------------------------------------------------

SCHEMA = "a int, b double, c string, d array<int>, e decimal(20,2)"


def some_rows(n, seed=1):
    rng = random.Random(seed)
    return [
        (
            rng.randrange(100) if rng.random() < 0.9 else None,
            rng.choice([rng.gauss(0, 1), float("nan"), None]),
            rng.choice(["x", "x", "y", None, f"z{rng.random()}"]),
            [1],
            None,
        )
        for _ in range(n)
    ]


def by_column(frame):
    return {r["column"]: r for r in frame.collect()}


def test_profile_of_batches_is_that_of_all_rows(spark, tmp_path):
    rows = some_rows(3000)
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    where = str(tmp_path / "profile"), str(tmp_path / "progress")

    def run():
        stream = ingest.file_stream(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
        ingest.profile_batches(stream, *where)
        return by_column(ingest.read_profile(spark, where[0]))

    found, batch = run(), by_column(profile.profile_columns(frame))
    assert set(found) == set(frame.columns)
    for name, wanted in batch.items():
        assert (found[name].rows, found[name].missing) == (3000, wanted.missing)
        assert found[name].mean == pytest.approx(wanted.mean) if wanted.mean is not None else found[name].mean is None
    values = sorted(r[0] for r in rows if r[0] is not None)
    assert abs(found["a"].median - statistics.median(values)) <= 2
    assert found["c"].mode == "x" and found["d"].mode is None
    assert found["e"].mean is None and found["e"].median is None
    # Nothing new: nothing changes. New rows come on top of what is there.
    assert run() == found
    spark.createDataFrame(some_rows(50, 2), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run()["a"].rows == 3050
    before = by_column(ingest.read_profile(spark, where[0]))
    ingest.compact_profile(spark, where[0])
    assert spark.read.parquet(where[0]).select("batch_id").distinct().count() == 2
    after = by_column(ingest.read_profile(spark, where[0]))
    assert {n: (r.rows, r.missing, r.mean) for n, r in after.items()} == {
        n: (r.rows, r.missing, r.mean) for n, r in before.items()
    }
    ingest.compact_profile(spark, where[0])
    assert by_column(ingest.read_profile(spark, where[0])).keys() == before.keys()


def test_a_repeated_batch_replaces_its_state(spark, tmp_path):
    frame = spark.createDataFrame(some_rows(100), SCHEMA)
    state = profile.profile_state(frame)
    for _ in range(2):
        state.write.mode("overwrite").parquet(str(tmp_path / "batch_id=0"))
    assert by_column(ingest.read_profile(spark, str(tmp_path)))["a"].rows == 100


def test_states_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert profile.profile_of_states(profile.profile_state(empty)).collect() == []
    nulls = by_column(profile.profile_of_states(profile.profile_state(spark.createDataFrame([(None,) * 5], SCHEMA))))
    assert all((r.rows, r.missing, r.mean, r.median, r.mode) == (1, 1, None, None, None) for r in nulls.values())


# --- each file once ----------------------------------------------------------


class Broken(Exception):
    pass


@pytest.fixture
def once(spark, tmp_path):
    """Seven files of ten rows; a load of them in batches of two that can break off."""
    source = str(tmp_path / "in")
    spark.range(70).repartition(7).write.parquet(source)

    def read(paths):
        return spark.read.schema("id bigint").parquet(*paths)

    def run(read=read, **more):
        given = source, str(tmp_path / "ledger"), read, str(tmp_path / "out"), "*.parquet"
        return ledger.ingest_once(spark, *given, batch_files=more.pop("batch_files", 2), **more)

    run.rows = lambda: sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run.more = lambda: spark.range(70, 80).coalesce(1).write.mode("append").parquet(source)
    return run


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_all_files_in_batches(once, size):
    assert once(batch_files=size) == 7
    assert once.rows() == list(range(70))
    assert once(batch_files=size) == 0
    once.more()
    assert once(batch_files=size) == 1
    assert once.rows() == list(range(80))


@pytest.mark.parametrize("act", range(6))
def test_breaking_off_anywhere(once, monkeypatch, act):
    """Ahead of a read, behind a write, ahead of and behind the ledger's entry, ahead of the mark."""
    calls = {"left": 1}

    def breaking(function, when_done):
        def run(*given):
            if calls["left"] == 0 and not when_done:
                raise Broken
            out = function(*given)
            if calls["left"] == 0:
                raise Broken
            calls["left"] -= 1
            return out

        return run

    with monkeypatch.context() as patch:
        done = bool(act % 2)
        if act < 2:
            patch.setattr(ledger, "_load_batch", breaking(ledger._load_batch, done))
        elif act < 4:
            patch.setattr(ledger, "_enter", breaking(ledger._enter, done))
        else:
            patch.setattr(replace.Files, "claim", breaking(replace.Files.claim, done))
        with pytest.raises(Broken):
            once()
    once.more()
    once(batch_files=3)
    assert once.rows() == list(range(80))
    assert once() == 0


def test_failing_again_and_again(once):
    def broken(number):
        raise Broken

    for _ in range(3):
        with pytest.raises(Broken):
            once(written=broken)
    assert once() == 7
    assert once.rows() == list(range(70))


# --- logs ----------------------------------------------------------------------


def test_many_writers_of_a_run(spark, tmp_path):
    path = str(tmp_path / "log")

    def write(writer):
        for i in range(4):
            entries = [(f"{writer}.{i}.{k}", {"k": k}) for k in range(1 + i % 3)]
            lineage.append(spark, path, "shared", entries)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    log = lineage.read_run(spark, path, "shared")
    seqs = sorted(r.seq for r in log.collect())
    assert seqs == list(range(4 * (1 + 2 + 3 + 1)))
    # The entries of an append follow each other.
    places = {r.name: r.seq for r in log.collect()}
    assert all(places[f"{w}.2.{k}"] == places[f"{w}.2.0"] + k for w in range(4) for k in range(3))
    assert lineage.read_log(spark, path).count() == len(seqs)


def test_a_run_is_read_from_its_partition(spark, tmp_path):
    path = str(tmp_path / "log")
    for run in range(12):
        lineage.append(spark, path, f"run {run}", [("load", {}), ("save", {})])
    plan = lineage.read_run(spark, path, "run 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert lineage.read_run(spark, path, "run 3").inputFiles() != []
    assert lineage.read_run(spark, path, "run 3").count() == 2
    assert lineage.read_run(spark, path, "none").count() == 0
    lineage.append(spark, path, "run 3", [])
    assert lineage.read_log(spark, path).count() == 24


def test_log_of_before_is_dealt_to_partitions(spark, tmp_path):
    path = str(tmp_path / "log")
    old = spark.createDataFrame(
        [("r", i, f"s{i}", None, {"a": "b"}) for i in range(3)] + [("q", 0, "x", None, {})], lineage.LOG_SCHEMA
    )
    old.withColumn("ts", F.current_timestamp()).write.parquet(path)
    lineage.append(spark, path, "r", [("more", {})])
    log = sorted((r.run_id, r.seq, r.name) for r in lineage.read_log(spark, path).collect())
    assert log == [("q", 0, "x"), ("r", 0, "s0"), ("r", 1, "s1"), ("r", 2, "s2"), ("r", 3, "more")]
    assert lineage.read_run(spark, path, "r").count() == 4
