"""Ranked lexical search with hashed max-sketches.

A document's impacts (what one occurrence count of a term is worth there, apart
from the term's weight) are folded into a short array: each term hashes to a
place, which keeps the largest impact that falls on it. Looking up the terms of
a query there gives no less than their true impacts, so the weighted sum bounds
the document's score from above. Documents are scored exactly in descending order
of their bounds until no bound reaches the score that the last place needs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.shared import documents
from sparkprep.llm.terms import WITH_DIGITS, terms
from sparkprep.session import new_path

# Fixed values of the score: an impact's numerator, the parts of a document's
# length norm, and what weights are multiplied by before they are cut to integers.
IMPACT = 1_000_000_000
SATURATION, LENGTH = 1000, 12
NORM, SHARE = 100, 25
WEIGHT = 1000

# Places of each array per distinct term, at least; impacts are stored in units of
# this many, rounded up.
SPREAD, UNIT = 4, 16
# One odd number per array, which scatters its hashes.
SCATTER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Text of the queries that go to the tasks at once; more are searched in further
# passes over the index. Inside a task, queries are looked up in groups, documents in blocks.
PASS_BYTES = 16 * 1024**2
GROUP_ITEMS, GROUP_BYTES = 64, 64 * 1024
BLOCK = 256
# Parts of the results of a query that are ranked apart before the last ranking.
PARTS = 256

INDEX = "doc_id bigint, sketch binary, terms binary, impacts binary"


@dataclass
class Index:
    """A written index and the sums that its impacts were made with."""

    path: str
    documents: int
    terms: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX).parquet(self.path)


def counted(text: str | None) -> Counter[bytes]:
    """How often each term comes in the whole text."""
    found: Counter[bytes] = Counter()
    for part in terms(text, WITH_DIGITS):
        found.update(part)
    return found


def norm(n: int, n_docs: int, n_terms: int) -> int:
    return NORM - SHARE + (SHARE * n * n_docs) // n_terms


def impacts_of(counts: Counter[bytes], n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of each of a document's terms."""
    m = norm(counts.total(), n_docs, n_terms)
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    return IMPACT * tf // (SATURATION * tf + LENGTH * m)


def places_of(names: list[bytes], width: int) -> np.ndarray:
    """Where terms fall in a sketch, a row per array; arrays are as wide as a power of two."""
    hashes = np.fromiter(map(crc32, names), np.uint64, len(names))
    mixed = (hashes * np.array(SCATTER, np.uint64)[:, None]) >> np.uint64(32)
    inside = (mixed & np.uint64(width - 1)).astype(np.int64)
    return inside + width * np.arange(len(SCATTER))[:, None]


def sketch_of(names: list[bytes], impacts: np.ndarray) -> np.ndarray:
    """The largest impact at each place, in units rounded up; the arrays end to end."""
    width = 1 << (SPREAD * len(names) - 1).bit_length()
    sketch = np.zeros(len(SCATTER) * width, np.uint16)
    units = ((impacts + UNIT - 1) // UNIT).astype(np.uint16)
    # One array at a time: ``at`` does not spread values over rows of places.
    for places in places_of(names, width):
        np.maximum.at(sketch, places, units)
    return sketch


def build_index(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> Index:
    """Write every document's sketch, terms and impacts under ``path``.

    Two passes over the texts: the first sums documents and terms, which the
    impacts depend on. Nothing is shuffled. A null text, and one without terms,
    is not in the index, as no query can find it. Other columns are not kept.
    """
    plain = documents(docs, id_column, text_column)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [
                sum(map(len, terms(t.as_py(), WITH_DIGITS))) for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([pa.array([s for s in sizes if s], pa.int64())], ["n"])

    sizes = plain.select("text").mapInArrow(measure, "n bigint")
    n_docs, n_terms = sizes.agg(F.count("n"), F.sum("n")).first()
    n_terms = n_terms or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sketches, blobs, impacts = [], [], [], []
            for name, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                counts = counted(text.as_py())
                if not counts:
                    continue
                names, values = list(counts), impacts_of(counts, n_docs, n_terms)
                ids.append(name.as_py())
                sketches.append(sketch_of(names, values).tobytes())
                blobs.append(b" ".join(names))
                impacts.append(values.astype(np.uint32).tobytes())
            columns = [
                pa.array(ids, pa.int64()),
                *(pa.array(c, pa.binary()) for c in (sketches, blobs, impacts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sketch", "terms", "impacts"])

    plain.mapInArrow(write, INDEX).write.option("compression", "zstd").parquet(path)
    return Index(path, n_docs, n_terms)


# --- queries --------------------------------------------------------------


@dataclass
class Group:
    """Queries that are looked up together, over one list of their terms."""

    first: int
    queries: list[Counter[bytes]]
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for query in self.queries:
            for term in query:
                self.vocabulary.setdefault(term, len(self.vocabulary))

    def weigh(self, weights: dict[bytes, int]) -> None:
        """Each query's terms as numbers, and what an impact counts in it."""
        self.numbers = [np.array([self.vocabulary[t] for t in q], np.int64) for q in self.queries]
        self.weights = [
            np.array([n * weights.get(t, 0) for t, n in q.items()], np.int64) for q in self.queries
        ]
        self.table = np.zeros((len(self.vocabulary), len(self.queries)))
        for at, (numbers, values) in enumerate(zip(self.numbers, self.weights, strict=True)):
            self.table[numbers, at] = values
        self.places: dict[int, np.ndarray] = {}

    def lookup(self, width: int) -> np.ndarray:
        """Where the terms of the queries are in sketches of this width."""
        if width not in self.places:
            self.places[width] = places_of(list(self.vocabulary), width)
        return self.places[width]


def _passes(queries: DataFrame, pass_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The queries in lists of no more text than ``pass_bytes``, or of one query."""
    taken, held = [], 0
    for row in queries.toLocalIterator():
        size = len((row.text or "").encode())
        if taken and held + size > pass_bytes:
            yield taken
            taken, held = [], 0
        taken.append((row.item_id, row.text))
        held += size + 64
    if taken:
        yield taken


def _groups(items: list[tuple[object, str]]) -> list[Group]:
    groups, first, taken, held = [], 0, [], 0
    for at, (_, text) in enumerate(items):
        query, size = counted(text), len((text or "").encode())
        if taken and (len(taken) == GROUP_ITEMS or held + size > GROUP_BYTES):
            groups.append(Group(first, taken))
            first, taken, held = at, [], 0
        taken.append(query)
        held += size
    return [*groups, Group(first, taken)]


class Best:
    """The best documents of one query so far: score, whether the id is null, id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows = np.zeros((0, 3), np.int64)

    @property
    def needed(self) -> int:
        """What a document must score to be among the best."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 1

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate((self.rows, rows[rows[:, 0] >= self.needed]))
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


class Block:
    """Some documents of the index, whose exact impacts are read when they are asked for."""

    def __init__(self, batch: pa.RecordBatch, group: Group) -> None:
        self.batch, self.group = batch, group
        self.exact = np.zeros((batch.num_rows, len(group.vocabulary)), np.int64)
        self.read = np.zeros(batch.num_rows, bool)

    def bounds(self) -> np.ndarray:
        """Documents by queries: no less than the scores."""
        sketches = [np.frombuffer(s.as_buffer(), np.uint16) for s in self.batch.column("sketch")]
        out = np.zeros((len(sketches), len(self.group.queries)))
        sizes = np.array([len(s) for s in sketches])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            places = self.group.lookup(int(size) // len(SCATTER))
            impacts = np.stack([sketches[i][places].min(axis=0) for i in at])
            out[at] = impacts.astype(np.float64) @ self.group.table
        # Sums of whole numbers below 2^53, or rounded by less than this share.
        return out * UNIT * (1 + 1e-9)

    def scores(self, rows: np.ndarray, query: int) -> np.ndarray:
        for row in rows[~self.read[rows]].tolist():
            names = self.batch.column("terms")[row].as_py().split(b" ")
            known = np.array(list(map(self.group.vocabulary.get, names, repeat(-1))), np.int64)
            impacts = np.frombuffer(self.batch.column("impacts")[row].as_buffer(), np.uint32)
            self.exact[row, known[known >= 0]] = impacts[known >= 0]
            self.read[row] = True
        return self.exact[np.ix_(rows, self.group.numbers[query])] @ self.group.weights[query]


def _search_block(block: Block, ids: np.ndarray, best: list[Best]) -> int:
    """Take a block's documents into the best of each query; how many scores that took."""
    bounds, scored = block.bounds(), 0
    needed = np.array([b.needed for b in best])
    for query in np.flatnonzero((bounds >= needed).any(axis=0)).tolist():
        mine, column = best[query], bounds[:, query]
        order = np.flatnonzero(column >= mine.needed)
        order = order[np.argsort(-column[order], kind="stable")]
        step, at = mine.k, 0
        while at < len(order) and column[order[at]] >= mine.needed:
            rows = order[at : at + step]
            found = block.scores(rows, query)
            mine.add(np.column_stack((found, ids[rows])))
            scored += len(rows)
            at += step
    return scored


RANKED = "query int, score bigint, doc_id bigint"


def _best_of_pass(
    spark: SparkSession, index: Index, items: list[tuple[object, str]], df: dict[bytes, int], k: int
) -> DataFrame:
    """(query, item_id, rank, doc_id, score): the best of all documents for each of the items."""
    n = index.documents
    weights = {t: math.floor(WEIGHT * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    groups = _groups(items)
    for group in groups:
        group.weigh(weights)
    sent = spark.sparkContext.broadcast(groups)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[Best(k) for _ in group.queries] for group in sent.value]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                names = part.column("doc_id")
                ids = np.column_stack((names.is_null(), names.fill_null(0)))
                for group, mine in zip(sent.value, best, strict=True):
                    _search_block(Block(part, group), ids, mine)
        for group, mine in zip(sent.value, best, strict=True):
            for at, found in enumerate(mine):
                rows = found.rows
                columns = [
                    pa.array(np.full(len(rows), group.first + at, np.int32)),
                    pa.array(rows[:, 0]),
                    pa.array(rows[:, 2], mask=rows[:, 1] == 1),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query", "score", "doc_id"])

    found = index.rows(spark).mapInArrow(search, RANKED)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    # k rows per task and query: ranked in parts first, so that no task ranks those of all tasks.
    parts = found.withColumn("part", F.spark_partition_id() % PARTS)
    in_part = F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))
    parts = parts.withColumn("rank", in_part).where(F.col("rank") <= k)
    overall = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return parts.drop("part").withColumn("rank", overall).where(F.col("rank") <= k)


def document_counts(index_rows: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of these terms is."""
    names = sorted(vocabulary)
    sent = index_rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = sent.value, Counter()
        for batch in batches:
            for blob in batch.column("terms"):
                found.update(known.keys() & blob.as_py().split(b" "))
        columns = [
            pa.array([known[t] for t in found], pa.int32()),
            pa.array(list(found.values()), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    counts = index_rows.select("terms").mapInArrow(count, "term int, n bigint")
    # A number per term of the queries of a pass.
    return {names[r.term]: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def search(
    index: Index,
    queries: DataFrame,
    k: int = 20,
    item_column: str = "item_id",
    text_column: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query, exactly.

    Scores are whole numbers above 0; equal ones go by ascending document id, a
    null id last. Each row of ``queries`` is a query of its own, also where rows
    repeat; one without terms (or null) finds nothing.

    Queries go to the tasks in passes of ``pass_bytes`` of text, so any number of
    them is answered; each pass reads the index twice (how many documents hold its
    terms; the search). A task gives up to ``k`` documents per query, and
    these are ranked in parts and then once more. Nothing else is shuffled.
    """
    spark = queries.sparkSession
    asked = queries.select(
        qcol(item_column).alias("item_id"), qcol(text_column).cast("string").alias("text")
    )
    item_type = asked.schema["item_id"].dataType.simpleString()
    out = None
    for items in _passes(asked, pass_bytes):
        vocabulary = set().union(*(counted(text) for _, text in items))
        df = document_counts(index.rows(spark), vocabulary)
        best = _best_of_pass(spark, index, items, df, k)
        names = spark.createDataFrame(
            [(i, name) for i, (name, _) in enumerate(items)], f"query int, item_id {item_type}"
        )
        found = names.join(best, "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id bigint, score bigint")
    return out


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 20, **columns: str) -> DataFrame:
    """``search`` over an index of ``docs`` made for this purpose in the shared folder."""
    spark = docs.sparkSession
    index = build_index(docs, new_path(spark, "llm-search"), **columns)
    return search(index, queries, k)
