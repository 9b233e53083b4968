"""Loading each arriving file once, in batch jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.session import new_path
from sparkprep.sources.catalog import list_files
from sparkprep.sources.replace import DEFAULT_FORMAT, Files
from sparkprep.sources.sinks import delete_path

FILE_KEY = ("file", "length")
LEDGER_SCHEMA = "file string, length bigint, loaded timestamp"
BATCH_FILES = 10_000


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, length, path) of a folder's files; ``file`` is the path inside the folder.

    The folder is cut off by its length, once: its own path may come again below it,
    and that of a whole file system, ``/``, is in every path. A pattern as the folder
    is in no path; then ``file`` is the path without the name of the file system.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(hadoop).toUri().getPath().rstrip("/") + "/"
    # Scheme and authority may be written in several ways, the path in one.
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    inside = F.when(
        plain.startswith(root), F.substring(plain, F.char_length(F.lit(root)) + 1, F.length("path"))
    ).otherwise(plain)
    return list_files(spark, folder, pattern).select(inside.alias("file"), "length", "path")


def new_arrivals(
    listing: DataFrame,
    ledger: DataFrame,
    keys: Sequence[str] = FILE_KEY,
    force: bool = False,
) -> DataFrame:
    """Entries of ``listing`` that the ledger does not have yet.

    The join side is left to the optimizer, which knows the ledger's size at
    run time and can split a hot key of the listing.
    """
    if force:
        return listing
    return listing.join(ledger.select(*keys), list(keys), "left_anti")


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, which is made, empty, before the first load."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    ledger_path: str,
    load: Callable[[list[str]], None],
    pattern: str = "*",
    force: bool = False,
    batch_files: int = BATCH_FILES,
) -> int:
    """Pass the paths of new files to ``load`` and enter them in the ledger.

    A file is known by its path inside the folder and its length. The folder is
    listed once; the new files of that listing are written to the shared folder
    and come from there in batches of at most ``batch_files``, so the driver
    holds no more paths than that and the size of a batch changes nothing. A
    batch enters the ledger only after its load succeeded: a load that failed,
    or whose entry was lost, is repeated by the next run, so ``load`` should not
    mind a repeat; ``ingest_once`` sees to that by itself. Returns the number of
    files loaded.
    """
    found = listed(spark, folder, pattern)
    arrivals = new_arrivals(found, load_ledger(spark, ledger_path), force=force)
    waiting = new_path(spark, "arrivals")
    arrivals.write.parquet(waiting)
    rows = spark.read.schema(arrivals.schema).parquet(waiting).orderBy("file").toLocalIterator()
    done = 0
    while batch := list(islice(rows, batch_files)):
        load([r["path"] for r in batch])
        _enter(spark, ledger_path, [(r["file"], r["length"]) for r in batch])
        done += len(batch)
    delete_path(spark, waiting)
    return done


# --- each file exactly once -----------------------------------------------

BATCHES = "_batches"
BATCH = "batch"


def ingest_once(
    spark: SparkSession,
    folder: str,
    ledger_path: str,
    read: Callable[[list[str]], DataFrame],
    output: str,
    pattern: str = "*",
    fmt: str = DEFAULT_FORMAT,
    batch_files: int = BATCH_FILES,
    written: Callable[[int], None] | None = None,
) -> int:
    """Read new files and add their rows to ``output``, each file exactly once.

    Every batch of files has a number and goes to a folder of its own, ``batch=<number>``.
    Ahead of that its files are entered as intended, and afterwards in the ledger. A run
    that finds an intent which is not in the ledger loads those files first, again
    into the same folder; so whatever broke off, and wherever, no row is there
    twice or lacking. ``written`` is called with the number of a batch when its rows are
    there; what it raises breaks the run off. Returns the number of files loaded.

    One run at a time: of two that claim the same number one fails, but the ledger
    does not keep them from loading the same files under different ones.
    """
    files = Files(spark, ledger_path)
    ledger = load_ledger(spark, ledger_path)
    files.make_folder(f"{ledger_path}/{BATCHES}")
    done = 0
    intents = sorted(c for c in files.children(f"{ledger_path}/{BATCHES}") if c.endswith(".json"))
    for intent in intents:
        entries = [tuple(e) for e in json.loads(files.read(intent))]
        number = int(intent.rpartition("/")[2].removesuffix(".json"))
        first = (F.col("file") == entries[0][0]) & (F.col("length") == entries[0][1])
        if ledger.where(first).isEmpty():
            _load_batch(spark, ledger_path, entries, number, read, output, fmt, written)
            done += len(entries)
        # What comes after the ledger's entry is only this mark.
        files.rename(intent, f"{intent.removesuffix('.json')}.done")
    found = listed(spark, folder, pattern)
    arrivals = new_arrivals(found, load_ledger(spark, ledger_path))
    waiting = new_path(spark, "arrivals")
    arrivals.write.parquet(waiting)
    rows = spark.read.schema(arrivals.schema).parquet(waiting).orderBy("file").toLocalIterator()
    numbers = [int(_number(c)) for c in files.children(f"{ledger_path}/{BATCHES}") if _number(c).isdigit()]
    number = max(numbers, default=-1) + 1
    while batch := list(islice(rows, batch_files)):
        entries = [(r["file"], r["length"], r["path"]) for r in batch]
        intent = f"{ledger_path}/{BATCHES}/{number:09d}"
        if not files.claim(f"{intent}.json", json.dumps(entries)):
            raise RuntimeError(f"batch {number} of {output} is being loaded by another run")
        _load_batch(spark, ledger_path, entries, number, read, output, fmt, written)
        files.rename(f"{intent}.json", f"{intent}.done")
        done, number = done + len(entries), number + 1
    delete_path(spark, waiting)
    return done


def _number(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def _load_batch(
    spark: SparkSession,
    ledger_path: str,
    entries: Sequence[tuple[str, int, str]],
    number: int,
    read: Callable[[list[str]], DataFrame],
    output: str,
    fmt: str,
    written: Callable[[int], None] | None,
) -> None:
    place = f"{output}/{BATCH}={number}"
    read([path for _, _, path in entries]).write.format(fmt).mode("overwrite").save(place)
    if written:
        written(number)
    _enter(spark, ledger_path, [(file, length) for file, length, _ in entries])


def _enter(spark: SparkSession, ledger_path: str, entries: Sequence[tuple[str, int]]) -> None:
    """Add files to the ledger: one file of it, so all of them or none."""
    (
        spark.createDataFrame(entries, "file string, length bigint")
        .withColumn("loaded", F.current_timestamp())
        .coalesce(1)
        .write.mode("append")
        .parquet(ledger_path)
    )
