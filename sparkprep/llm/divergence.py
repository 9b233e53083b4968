"""How far the vocabularies of sources diverge, inside each language.

A group is a source in a language. Every term that enough documents of the
language hold is kept, and a group gives it a smoothed share of its occurrences,
in billionths. Two groups diverge by the sum of the differences of these shares
over all kept terms, whether a group has the term or not.

Groups by terms is a sparse matrix; terms are its columns, kept as an index from
terms to groups. A group's row is spread through that index into one accumulator
per peer (Gustavson's row accumulation), so a pair of groups is a number in an
array and never a row per shared term. An absent term has a share too, the
group's least one. So the accumulators hold corrections: from what two groups
would differ by if they shared no term to what they do.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.shared import saved
from sparkprep.llm.terms import LETTERS, terms

# Shares are in units of one of this many, from this much more
# than each count.
SCALE_STEP, SCALE_STEPS = 1000, 3
ADDED = 5
# Entries of a task's counts that are held before they are passed on, and of the
# index that a shard holds.
HELD = 500_000
SHARD_POSTINGS = 1 << 20

COUNTS = "lang string, source string, term string, n bigint, docs bigint"
PARTS = "a string, b string, term string, value bigint"


def counted(docs: DataFrame, lang_column: str, source_column: str, text_column: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of terms, and documents with them, by group.

    Each group has a row without a term as well, so that none is lost. Tasks sum
    what they read before anything is shuffled.
    """

    def empty_if_null(name: str, alias: str):
        return F.coalesce(qcol(name).cast("string"), F.lit("")).alias(alias)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.add((lang, source), text)
                if held.size > HELD:
                    yield held.rows()
                    held = _Counts()
        yield held.rows()

    plain = docs.select(
        empty_if_null(lang_column, "lang"),
        empty_if_null(source_column, "source"),
        empty_if_null(text_column, "text"),
    )
    parts = plain.mapInArrow(count, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


class _Counts:
    """Occurrences and documents by group and term, as far as one task has read."""

    def __init__(self) -> None:
        self.n: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        self.size = 0

    def add(self, group: tuple[str, str], text: str) -> None:
        n, docs = self.n[group], self.docs[group]
        before, seen = len(n), set()
        for part in terms(text, LETTERS):
            n.update(part)
            seen.update(part)
        docs.update(seen)
        self.size += len(n) - before

    def rows(self) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), n in self.n.items():
            docs, size = self.docs[lang, source], len(n) + 1
            columns[0] += [lang] * size
            columns[1] += [source] * size
            columns[2] += [None, *(t.decode() for t in n)]
            columns[3] += [0, *n.values()]
            columns[4] += [0, *map(docs.__getitem__, n)]
        types = [pa.string()] * 3 + [pa.int64()] * 2
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / total), exactly; ``total`` is above 0 and below 9e15."""
    rest, out = counts + ADDED, np.zeros_like(counts)
    for step in range(SCALE_STEPS + 1):
        whole, rest = np.divmod(rest, total)
        out = out + whole
        if step < SCALE_STEPS:
            out, rest = out * SCALE_STEP, rest * SCALE_STEP
    return out + 1


class Shard:
    """Some terms of a language with the groups that have them, term by term.

    ``totals`` has N + 5 V for every group, and for the language as a whole.
    """

    def __init__(
        self, ends: np.ndarray, groups: np.ndarray, counts: np.ndarray, totals: np.ndarray, whole: int
    ) -> None:
        self.starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        self.sizes = ends - self.starts
        self.groups, self.totals = groups, totals
        self.term = np.repeat(np.arange(len(ends)), self.sizes)
        self.share = share(counts, totals[groups])
        self.least = share(np.zeros(len(totals), np.int64), totals)
        self.shared = np.bincount(groups, minlength=len(totals))
        sums = np.zeros(len(ends), np.int64)
        np.add.at(sums, self.term, counts)
        self.over = self.share - share(sums, np.array(whole))[self.term]
        # Where the entries of each group are, in the order of the terms.
        self.by_group = np.argsort(groups, kind="stable")
        self.edges = np.concatenate(([0], np.cumsum(self.shared)))

    def entries(self, group: int) -> np.ndarray:
        return self.by_group[self.edges[group] : self.edges[group + 1]]

    def apart(self, group: int) -> np.ndarray:
        """How far the group's terms are from every group's least share, summed."""
        values = np.sort(self.share[self.entries(group)])
        upto = np.concatenate(([0], np.cumsum(values)))
        below = np.searchsorted(values, self.least)
        left = self.least * below - upto[below]
        return left + upto[-1] - upto[below] - self.least * (len(values) - below)

    def corrections(self, group: int) -> np.ndarray:
        """What sharing terms takes from the sum of both groups' ``apart``, for every peer.

        Each of the group's terms is followed to the groups that have it, whose
        accumulators take the difference.
        """
        mine = self.entries(group)
        sizes = self.sizes[self.term[mine]]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(
            self.starts[self.term[mine]], sizes
        )
        peers, theirs, own = self.groups[at], self.share[at], np.repeat(self.share[mine], sizes)
        least, own_least = self.least[peers], self.least[group]
        values = (
            np.abs(own - theirs)
            - np.abs(own - least)
            - np.abs(own_least - theirs)
            + np.abs(own_least - least)
        )
        # Shares of a group sum to little more than 10^9, so doubles are exact here.
        found = np.bincount(peers, weights=values, minlength=len(self.totals))
        return np.rint(found).astype(np.int64)

    def halves(self, group: int) -> np.ndarray:
        """The group's part of its distance to every peer, over the terms of this shard.

        The distance of two groups is the sum of both parts; what is common to
        them is in the part of the first of the two.
        """
        out = self.apart(group)
        neither = len(self.sizes) - self.shared[group] - self.shared
        common = self.corrections(group) + neither * np.abs(self.least[group] - self.least)
        out[group + 1 :] += common[group + 1 :]
        return out

    def most_over(self, group: int, k: int) -> np.ndarray:
        """The group's entries that are furthest above the language's share, with ties by term."""
        mine = self.entries(group)
        mine = mine[self.over[mine] > 0]
        return mine[np.argsort(-self.over[mine], kind="stable")[:k]]


def _audit_shard(groups: pa.Table, index: pa.Table, k: int) -> pa.Table:
    """Rows for pairs (a, b) of groups and for (a, term) of one shard of a language."""
    groups = groups.sort_by("source")
    names = groups.column("source").combine_chunks()
    if index.num_rows:
        index = index.sort_by("term")
    lists = index.column("postings").combine_chunks()
    entries = lists.flatten()
    of_source = pc.index_in(entries.field("source"), value_set=names)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    kept, out = groups.column("kept")[0].as_py(), []
    if kept:
        totals = groups.column("n").to_numpy() + ADDED * kept
        whole = groups.column("lang_n")[0].as_py() + ADDED * kept
        shard = Shard(
            ends,
            of_source.to_numpy(zero_copy_only=False).astype(np.int64),
            entries.field("n").to_numpy(zero_copy_only=False).astype(np.int64),
            totals,
            whole,
        )
    nothing = pa.nulls(len(names) - 1, pa.string())
    for at, name in enumerate(names):
        values = shard.halves(at) if kept else np.zeros(len(names), np.int64)
        others = np.delete(np.arange(len(names)), at)
        own = pa.array([name.as_py()] * len(others), pa.string())
        peers = names.take(pa.array(others))
        # Both groups' parts meet under the smaller name.
        first = pa.array(others > at)
        pairs = [pc.if_else(first, own, peers), pc.if_else(first, peers, own), nothing]
        out.append(pa.Table.from_arrays([*pairs, pa.array(values[others])], ["a", "b", "term", "value"]))
        if kept and (top := shard.most_over(at, k)).size:
            found = index.column("term").take(pa.array(shard.term[top]))
            own = pa.array([name.as_py()] * len(top), pa.string())
            rows = [own, pa.nulls(len(top), pa.string()), found, pa.array(shard.over[top])]
            out.append(pa.Table.from_arrays(rows, ["a", "b", "term", "value"]))
    return pa.concat_tables(out) if out else _NO_PARTS


_NO_PARTS = pa.schema(
    [("a", pa.string()), ("b", pa.string()), ("term", pa.string()), ("value", pa.int64())]
).empty_table()


def audit(
    docs: DataFrame,
    min_docs: int = 30,
    top_terms: int = 50,
    lang_column: str = "lang",
    source_column: str = "source",
    text_column: str = "text",
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group.

    Part ``pair``: each other source of the language and how far the two are
    apart. Part ``term``: the ``top_terms`` terms that are most above their share
    in the language. Ranks count from 1, by descending value and then by item.

    A null language, source or text is an empty one. Repeated rows count each
    time. Groups without terms, and languages that keep none, have their pairs
    too. A language of one group has no pairs. Other columns are not looked at.

    The index of a language is cut into shards of about ``shard_postings`` entries,
    so that one with most of the text is many tasks; a shard gives one number per
    pair of groups, which are summed. A task holds a shard and an array over the
    language's groups. Only the result grows with the square of the groups.
    """
    counts = saved(counted(docs, lang_column, source_column, text_column), "term-counts")
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term")
    index = by_term.agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings")
    )
    index = saved(index.where(F.col("docs") >= min_docs).drop("docs"), "term-index")

    kept = index.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.size("postings")).alias("entries")
    )
    flat = index.select("lang", F.explode("postings").alias("p"))
    sums = flat.groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.n").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source")
    groups = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.na.fill(0, ["n", "kept", "entries"]).withColumn(
        "shards", F.greatest(F.ceil(F.col("entries") / shard_postings).cast("int"), F.lit(1))
    )
    totals = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.max("shards").alias("shards"))
    groups = saved(groups.drop("shards").join(totals, "lang"), "term-groups")
    shards = groups.groupBy("lang").agg(F.max("shards").alias("shards"))

    dealt = index.join(shards, "lang").select(
        "lang", "term", "postings", F.expr("pmod(xxhash64(term), shards)").cast("int").alias("shard")
    )
    present = groups.select(
        "lang", "source", "n", "kept", "lang_n", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard")
    )

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _audit_shard(left, right, top_terms)
        lang = pa.array([key[0].as_py()] * found.num_rows, pa.string())
        return found.add_column(0, "lang", lang)

    parts = (
        present.groupBy("lang", "shard")
        .cogroup(dealt.groupBy("lang", "shard"))
        .applyInArrow(work, f"lang string, {PARTS}")
    )
    parts = saved(parts, "divergence")
    pairs = parts.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("s"), "value")
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    over = parts.where("term IS NOT NULL").select(
        "lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value"
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
