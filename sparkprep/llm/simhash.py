"""Near-duplicate documents by SimHash, candidates pruned by segment chains."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.graph import components
from sparkprep.llm.shared import documents, fresh, saved

SEED = 42
# Shingles whose bits are counted at a time, so that long texts need no more
# memory than others.
SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of one text, as a signed number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    for at in range(0, total, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        parts = zip(*(part[i:] for i in range(shingle)), strict=False)
        n = len(part) - shingle + 1
        hashes = np.fromiter((digest(join(p), SEED) for p in parts), np.uint64, n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) for (doc_id, text)."""

    @F.pandas_udf("bigint")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(t, shingle) for t in part], dtype="int64")

    return docs.select("doc_id", simhash("text").alias("fp"))


def segments(max_bits: int) -> list[list[int]]:
    """The 64 bit positions cut into ``max_bits + 1`` runs."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], most: int) -> list[tuple[int, int]]:
    """(mask, number of bits) of every choice of up to ``most`` of the bits."""
    return [(_mask(list(c)), r) for r in range(most + 1) for c in combinations(bits, r)]


def _flipped(rows: DataFrame, bits: list[int], most: int, near: int) -> DataFrame:
    """Each row with every mask of up to ``most`` of the bits.

    ``near``: it has no more than ``near`` bits.
    """
    flips = _flips(bits, most)
    masks = F.lit(np.array([mask for mask, _ in flips], np.int64))
    few = sum(r <= near for _, r in flips)
    return rows.select("*", F.posexplode(masks).alias("at", "mask")).select(
        *rows.columns, "mask", (F.col("at") < few).alias("near")
    )


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints (``fp``) within ``max_bits``.

    Not every pair: the edges connect exactly the fingerprints that chains of
    pairs connect. Two fingerprints with at most d = ``max_bits`` differing bits,
    cut into d + 1 segments in a ring, have a segment from which every run of l
    segments differs in at most l * d / (d + 1) bits, that is l - 1. Each round
    asks for one more segment of that chain and drops what has no partner left:
    the first segment equal and one of the halves of the second; then chains of
    two segments, and so on to the whole ring, which is the Hamming check. A
    budget of e bits is met by two fingerprints if one with up to e // 2 bits
    flipped equals the other with the rest flipped, so each round is a grouping
    by key, linear in the rows: no pairs are made, however many fingerprints
    share a segment.
    """
    runs = segments(max_bits)
    m = len(runs)
    starts = distinct.select("fp", F.explode(F.array(*map(F.lit, range(m)))).alias("i"))
    alive = _first_segments(starts, runs) if m > 1 else starts.limit(0)
    for length in range(2, m + 1):
        budget = length - 1
        far, near = budget - budget // 2, budget // 2
        made = None
        for i in range(m):
            chain = [runs[(i + j) % m] for j in range(length)]
            free = [b for run in chain[1:] for b in run]
            keep = _mask([b for run in chain for b in run])
            key = F.col("fp").bitwiseAND(F.lit(keep)).bitwiseXOR(F.col("mask"))
            rows = _flipped(alive.where(F.col("i") == i), free, far, near).select(
                "fp", "i", key.alias("key"), "near"
            )
            made = rows if made is None else made.unionByName(rows)
        if length == m:
            return _star_edges(made)
        groups = (
            made.groupBy("i", "key")
            .agg(
                F.bool_or("near").alias("near"), F.min("fp").alias("low"), F.max("fp").alias("high")
            )
            .where("near AND low <> high")
        )
        alive = saved(
            made.join(groups.select("i", "key"), ["i", "key"], "left_semi")
            .select("fp", "i")
            .distinct(),
            "chains",
        )
    return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)


def _first_segments(starts: DataFrame, runs: list[list[int]]) -> DataFrame:
    """Those that share a first segment and half of the second with another.

    Of the one bit by which the second may differ, one half is free.
    """
    m = len(runs)
    masks = []
    for i in range(m):
        second = runs[(i + 1) % m]
        halves = second[: len(second) // 2], second[len(second) // 2 :]
        masks.append([_mask(runs[i] + half) for half in halves])
    table = F.array(*(F.array(*map(F.lit, pair)) for pair in masks))
    rows = starts.select("fp", "i", F.posexplode(table[F.col("i")]).alias("half", "mask"))
    rows = rows.select("fp", "i", "half", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = rows.groupBy("i", "half", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return saved(
        rows.join(shared, ["i", "half", "key"], "left_semi").select("fp", "i").distinct(), "chains"
    )


def _star_edges(made: DataFrame) -> DataFrame:
    """Each fingerprint with the smallest near one that shares a key with it.

    A key is within one or two bits of each of its fingerprints, so a group has
    65 of them at most, or 2081 where two bits are flipped.
    """
    least = F.min(F.when(F.col("near"), F.col("fp")))
    groups = (
        made.groupBy("key")
        .agg(least.alias("least"), F.collect_set("fp").alias("fps"))
        .where("least IS NOT NULL AND size(fps) > 1")
    )
    edges = groups.select(F.explode("fps").alias("u"), F.col("least").alias("v"))
    return edges.where("u <> v").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Texts are lower-cased (A-Z only) and cut into words at white space; the
    fingerprint is the majority of the bits of the hashes of all word shingles,
    as 16 hexadecimal digits. A text with fewer words than a shingle is one
    shingle; a null or empty text has fingerprint zero, which links like any
    other. Documents whose fingerprints differ in ``max_bits`` bits or fewer
    (0 to 3) are linked; ``component_id`` is the smallest id reachable. Null
    ids are kept and count for no component; rows that repeat stay. Other
    columns are ignored. Linking works on distinct fingerprints, so a group of
    exact copies counts once however large it is.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    marked = saved(fingerprints(documents(docs, id_column, text_column), shingle), "simhash")
    first = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(first.select("fp"), max_bits))
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(best, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def representatives(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row, all columns kept, of each group of near-duplicates: the smallest id.

    Rows that share an id are one document; the one with the least hash of its
    text stays. Rows without an id cannot be referred to and all stay.
    """
    classes = near_duplicates(docs, shingle, max_bits, id_column, text_column)
    kept = classes.where("doc_id = component_id").select("doc_id").distinct()
    id_, text = qcol(id_column), qcol(text_column)
    (row,) = fresh(docs, "row")
    whole = F.struct(*(qcol(c) for c in docs.columns)).alias(row)
    mine = docs.join(kept.withColumnRenamed("doc_id", f"{row}_id"), id_ == F.col(f"{row}_id"), "left_semi")
    single = mine.groupBy(id_).agg(F.min_by(whole, F.xxhash64(text)).alias(row))
    return single.select(f"`{row}`.*").unionByName(docs.where(id_.isNull()))
