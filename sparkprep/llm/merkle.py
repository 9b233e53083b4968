"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.shared import documents

# Words of a phrase, the leaves of the tree.
PHRASE_WORDS = 4
# A section ends at a blank line, or behind a paragraph whose hash has so many
# zero bits at its end (one in eight): the text itself decides, so an edit moves
# no section border but its own.
SECTION_BITS = 3
# Least leaf hashes kept in a fingerprint, of 32 bits each.
SKETCH = 128
# Bytes of a hash.
DIGEST = 16

_PHRASE = re.compile(rf"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){{1,{PHRASE_WORDS}}}|[\x20\x09-\x0D]+")
_MASK = (1 << SECTION_BITS) - 1

NODES = (
    "doc_id bigint, level int, place bigint, parent bigint, start bigint, end bigint, hash string"
)


@dataclass(frozen=True)
class Node:
    """A stretch of the text: level 0 is a phrase, 1 a paragraph, 2 a section, 3 the root."""

    level: int
    place: int
    parent: int
    start: int
    end: int
    digest: bytes


def _leaf(phrase: str) -> bytes:
    data = phrase.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def _joined(digests: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(digests), digest_size=DIGEST).digest()


def _closes(line: str, digest: bytes) -> bool:
    """Whether a section ends behind this paragraph."""
    return not digest[-1] & _MASK or not line.strip()


def tree(text: str | None) -> list[Node]:
    """All nodes, root last; every character is in one node of each level.

    Paragraphs are lines with their line end, phrases four words with the white
    space behind them. A node's hash is that of its children's hashes; a leaf's
    that of its text. The empty text is a root without children.
    """
    text = text or ""
    nodes: list[Node] = []
    sections: list[bytes] = []
    paragraphs: list[bytes] = []
    leaf = paragraph = at = opened = 0
    for line in text.splitlines(keepends=True) if text else ():
        phrases = []
        for m in _PHRASE.finditer(line):
            phrases.append(_leaf(m[0]))
            nodes.append(Node(0, leaf, paragraph, at + m.start(), at + m.end(), phrases[-1]))
            leaf += 1
        digest = _joined(phrases)
        nodes.append(Node(1, paragraph, len(sections), at, at + len(line), digest))
        paragraphs.append(digest)
        paragraph += 1
        at += len(line)
        if _closes(line, digest) or at == len(text):
            sections.append(_joined(paragraphs))
            nodes.append(Node(2, len(sections) - 1, 0, opened, at, sections[-1]))
            paragraphs, opened = [], at
    nodes.append(Node(3, 0, 0, 0, len(text), _joined(sections)))
    return nodes


@dataclass(frozen=True)
class Print:
    """What a fingerprint says: the root's hash, and the least hashes of phrases."""

    root: str
    leaves: np.ndarray

    def text(self) -> str:
        return self.root + self.leaves.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> Print:
    """The root and the leaves of ``tree(text)``, without the nodes in between."""
    text = text or ""
    sections: list[bytes] = []
    paragraphs: list[bytes] = []
    leaves: list[bytes] = []
    at = 0
    for line in text.splitlines(keepends=True) if text else ():
        found = [_leaf(p) for p in _PHRASE.findall(line)]
        leaves += found
        digest = _joined(found)
        paragraphs.append(digest)
        at += len(line)
        if _closes(line, digest) or at == len(text):
            sections.append(_joined(paragraphs))
            paragraphs = []
    firsts = np.frombuffer(b"".join(leaves), ">u4")[:: DIGEST // 4]
    return Print(_joined(sections).hex(), np.unique(firsts.astype(np.uint32))[:SKETCH])


def parsed(fingerprint_text: str) -> Print:
    root, sketch = fingerprint_text[: 2 * DIGEST], fingerprint_text[2 * DIGEST :]
    return Print(root, np.frombuffer(bytes.fromhex(sketch), ">u4").astype(np.uint32))


def likeness(a: Print, b: Print) -> float:
    """Share of the two texts' phrases that they have in common, from the sketches.

    Equal roots give 1. Otherwise the resemblance r of the sets is read off the
    least hashes of both together (exact up to 128 different phrases) and turned
    into the share 2r / (1 + r).
    """
    if a.root == b.root:
        return 1.0
    both = np.union1d(a.leaves, b.leaves)
    if max(len(a.leaves), len(b.leaves)) == SKETCH:
        both = both[:SKETCH]
    if not len(both):
        return 0.0
    common = np.intersect1d(a.leaves, b.leaves, assume_unique=True)
    r = float(np.isin(both, common, assume_unique=True).mean())
    return 2 * r / (1 + r)


def nodes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All nodes of all documents' trees.

    (doc_id, level, place, parent, start, end, hash): ``place`` numbers the nodes
    of a level, ``parent`` is the place of the node above, the range is in
    characters. A null text counts as the empty text.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "level", "place", "parent", "start", "end", "hash"]
        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows = [
                    (name, n.level, n.place, n.parent, n.start, n.end, n.digest.hex())
                    for n in tree(text)
                ]
                yield pd.DataFrame(rows, columns=names)

    rows = documents(docs, id_column, text_column)
    rows = rows.select(F.col("doc_id").cast("string"), "text")
    out = rows.mapInPandas(split, NODES.replace("doc_id bigint", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Where the trees of equal ids differ: the lowest nodes without an equal.

    ``old`` and ``new`` are node tables; gives (doc_id, side, level, start, end).
    Equal roots end the comparison; below a differing node, the children whose
    hash is nowhere in the other document's level are followed. A differing node
    all of whose children are found (they were moved or dropped) is given
    itself. Each level is one join on id, level and hash.
    """

    def one_side(mine: DataFrame, theirs: DataFrame, side: str) -> DataFrame:
        there = theirs.select("doc_id", "level", "hash").distinct()
        differing = mine.join(there, ["doc_id", "level", "hash"], "left_anti")
        followed = differing.where("level = 3")
        lowest = None
        for level in (2, 1, 0):
            children = differing.where(F.col("level") == level)
            below = children.select(
                "doc_id", F.lit(level + 1).alias("level"), F.col("parent").alias("place")
            ).distinct()
            kept = followed.join(below, ["doc_id", "level", "place"], "left_anti")
            lowest = kept if lowest is None else lowest.unionByName(kept)
            above = followed.select("doc_id", F.col("place").alias("parent"))
            followed = children.join(above, ["doc_id", "parent"], "left_semi").select(mine.columns)
        lowest = lowest.unionByName(followed)
        return lowest.select("doc_id", F.lit(side).alias("side"), "level", "start", "end")

    return one_side(old, new, "old").unionByName(one_side(new, old, "new"))


PAIRS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The second half of the text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def against_next(
    docs: DataFrame,
    runs: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Fingerprints of each text, and of it with its end taken from the next document.

    The next document has the next smaller id; after the last comes the first.
    Ids are cut into ``runs`` ranges (a few per shuffle partition) at ids that
    exist; each range is one sorted stream, to which the first row of the next
    range is added, so texts are shuffled once and a task holds two texts at a
    time. Null texts count as empty; a null id comes last; rows that share an id
    are ordered by text, so their neighbours are well defined. A table of one row
    is its own next.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_column, text_column)
    least = -(1 << 63)
    rows = rows.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(least)).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / runs for i in range(1, runs)]
    found = rows.agg(
        F.max("key").alias("top"), F.percentile_approx("key", shares, 20 * runs).alias("cuts")
    ).first()
    if found.top is None:
        return spark.createDataFrame([], PAIRS)
    # Run k holds the ids from heads[k] down to just above heads[k + 1].
    heads = sorted({found.top, *(found.cuts or ())}, reverse=True)
    last = len(heads) - 1
    run = F.lit(last) - _number_below(heads[::-1], F.col("key"))
    own = F.struct(run.alias("run"), F.lit(False).alias("ahead"))
    before = F.when(run > 0, run - 1).otherwise(F.lit(last))
    ahead = F.struct(before.alias("run"), F.lit(True).alias("ahead"))
    is_head = F.col("key").isin(heads)
    dealt = rows.withColumn(
        "to", F.explode(F.when(is_head, F.array(own, ahead)).otherwise(F.array(own)))
    ).select("doc_id", "key", "text", "to.run", "to.ahead")
    order = [F.col("run"), F.col("ahead"), F.desc("key"), F.col("text")]
    streams = dealt.repartition("run").sortWithinPartitions(*order)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = None  # run, id, text, fingerprint
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("run", "ahead", "doc_id", "text"))
            for at, extra, name, text in zip(*columns, strict=True):
                if extra and (mine is None or mine[0] != at):
                    continue  # only the first row of the next range is wanted
                theirs = fingerprint(text)
                if mine is not None and mine[0] == at:
                    out.append(_compared(mine, text, theirs))
                mine = None if extra else (at, name, text, theirs)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    ready = streams.select("run", "ahead", F.col("doc_id").cast("string"), "text")
    out = ready.mapInPandas(compare, PAIRS.replace("doc_id bigint", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _number_below(values: list[int], key: Column) -> Column:
    """How many of the sorted values are less than the key.

    Looks at every so manieth value first and then at the ones behind it.
    """
    step = math.isqrt(len(values)) + 1
    coarse = F.lit(np.array(values[::step], np.int64))
    fine = F.lit(np.array(values, np.int64))
    less = F.array_size(F.filter(coarse, lambda v: v < key))
    start = F.greatest(less - 1, F.lit(0)) * step
    part = F.slice(fine, start + 1, F.lit(step))
    return start + F.array_size(F.filter(part, lambda v: v < key))


def _compared(mine: tuple, following: str, theirs: Print) -> tuple:
    _, name, text, own = mine
    changed = edited(text, following)
    other = fingerprint(changed)
    return (
        name,
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        own.text(),
        other.text(),
        likeness(own, other),
        likeness(own, theirs),
    )
