"""Benchmark decontamination with an Aho-Corasick automaton over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.shared import fresh

WINDOW = 10
# Benchmark text in one automaton, and in all of them: these go to every task.
AUTOMATON_BYTES = 1024**2
MAX_BENCHMARK_BYTES = 64 * 1024**2

# A word is a run of letters, digits and bytes beyond ASCII. All else becomes a
# space; A-Z becomes a-z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32
    for b in range(256)
)
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")

FOUND = (
    "n_words bigint, n_hit bigint, items array<string>,"
    " spans array<struct<start: bigint, end: bigint>>"
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(found: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; the whole if there are fewer, but not none."""
    if not found:
        return []
    return [tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]


class Matcher:
    """One automaton over the windows of some items; a state reads a word."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            for window in windows(words(text), size):
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window)
                owners.setdefault(key, set()).update(() if name is None else (name,))
        self.owners = list(owners.values())
        self.lengths = [len(key) for key in owners]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for at, key in enumerate(owners):
            self.automaton.add_word(key, at)
        if owners:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Mark the words inside occurrences; ``hit`` counts opened less closed ones."""
        if not self.owners:
            return
        number = self.numbers.get
        for end, at in self.automaton.iter(tuple([number(w, 0) for w in found])):
            hit[end + 1 - self.lengths[at]] += 1
            hit[end + 1] -= 1
            items |= self.owners[at]


def spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character ranges of the original text that runs of hit words take."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [
        {"start": places[a][0], "end": places[b - 1][1]}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    ]


def _benchmark_parts(
    benchmark: DataFrame, id_column: str, text_column: str
) -> list[list[tuple[str | None, str | None]]]:
    """The items in parts of up to AUTOMATON_BYTES (a longer item is a part)."""
    items = benchmark.select(
        qcol(id_column).cast("string").alias("item"), qcol(text_column).cast("string").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"{size} bytes of benchmark text; pass it in parts")
    parts, room = [[]], AUTOMATON_BYTES
    for row in items.sort("item", "text").toLocalIterator():
        length = len((row.text or "").encode("utf-8", "surrogatepass"))
        if parts[-1] and length > room:
            parts, room = [*parts, []], AUTOMATON_BYTES
        parts[-1].append((row.item, row.text))
        room -= length
    return parts


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> Column:
    """A struct (n_words, n_hit, items, spans) for each row.

    Words are runs of ASCII letters and digits, lower-cased, and of characters
    beyond ASCII. Each run of ``window`` words of an item (the whole item, if
    shorter) is a pattern; a document word inside any occurrence of a pattern is
    hit. ``items`` are the ids, as text, of items with an occurring pattern,
    sorted; ``spans`` the character ranges of hit words in the original text.

    All patterns are in one automaton that reads word numbers, so its states
    grow with words and not characters, and each text is read once. Beyond
    1 MB of benchmark text there are several automata, all used in the same pass
    over a batch. The benchmark goes to every task: over 64 MB of it are refused
    and have to come in parts. Null and empty texts have no words; an item
    without words has no pattern, one without id counts for hits only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        _benchmark_parts(benchmark, item_id_column, item_text_column)
    )

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts = shared.value
        alone = Matcher(parts[0], window) if len(parts) == 1 else None
        for batch in batches:
            found = [words(t) for t in batch]
            edges = [np.zeros(len(f) + 1, np.int32) for f in found]
            items: list[set[str]] = [set() for _ in found]
            for part in parts:
                matcher = alone or Matcher(part, window)
                for f, e, i in zip(found, edges, items, strict=True):
                    matcher.scan(f, e, i)
            hit = [np.cumsum(e[:-1]) > 0 for e in edges]
            yield pd.DataFrame(
                {
                    "n_words": [len(f) for f in found],
                    "n_hit": [int(h.sum()) for h in hit],
                    "items": [sorted(i) for i in items],
                    "spans": [
                        spans(t, h) if h.any() else [] for t, h in zip(batch, hit, strict=True)
                    ],
                }
            )

    return scan(qcol(text_column).cast("string"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every document; see ``hits``.

    Rows that repeat stay; a null document id is kept.
    """
    found = hits(docs, benchmark, window, text_column, item_id_column, item_text_column)
    marked = docs.select(qcol(id_column).cast("bigint").alias("doc_id"), found.alias("found"))
    return marked.select("doc_id", "found.*")


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text"
) -> DataFrame:
    """The rows, all columns kept, without a word that is hit."""
    (found,) = fresh(docs, "found")
    marked = docs.withColumn(found, hits(docs, benchmark, window, text_column))
    return marked.where(F.col(found)["n_hit"] == 0).drop(found)
