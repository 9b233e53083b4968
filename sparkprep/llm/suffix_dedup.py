"""Removal of byte strings that start earlier too, by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.blocks import (
    Block,
    Mail,
    Message,
    anchors,
    covered,
    each_block,
    exchange,
    keep,
    least_per_key,
    mixed,
    names,
    ordered_ids,
    pack_sorted,
    paired,
    per_key,
    runs_of,
    send,
    some_smaller,
    unpack_sorted,
    write_blocks,
)

THRESHOLD = 100
# Places looked at together, so that the arrays of a long text stay small.
SLICE = 1 << 20

KEPT_BYTES = (
    "doc_id string, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>,"
    " kept binary"
)


def lengths(threshold: int) -> list[int]:
    """The lengths at which positions are ranked: from a quarter on, doubled up to the threshold."""
    out = [max(1, -(-threshold // 4))]
    while out[-1] < threshold:
        out.append(min(2 * out[-1], threshold))
    return out


def offsets(steps: list[int]) -> list[list[int]]:
    """For each length, where in a string of the threshold's length its parts start."""
    out = [[0]]
    for shorter, longer in zip(steps[-2::-1], steps[:0:-1], strict=True):
        out.append(sorted({o + d for o in out[-1] for d in (0, longer - shorter)}))
    return out[::-1]


class Bytes:
    """A block's texts with a zero byte behind each; strings never reach across."""

    def __init__(self, block: Block, threshold: int) -> None:
        self.data = b"".join(t + b"\0" for t in block.texts())
        self.ends = np.cumsum(block.lengths + 1) - 1
        self.begins = self.ends - block.lengths
        self.owners = ordered_ids(block.ids)
        self.total = len(self.data)
        self.threshold = threshold
        self.gram = max(1, threshold * 12 // 25)
        self.steps = lengths(threshold)
        self.single = np.frombuffer(self.data, np.uint8)
        # The eight bytes from each place on.
        eight = max(0, self.total - 7)
        self.eight = np.ndarray((eight,), "<u8", self.data, strides=(1,)) if eight else None

    def fits(self) -> np.ndarray:
        """Whether a string of the threshold's length starts here."""
        out = np.zeros(self.total + 1, np.int32)
        np.add.at(out, np.maximum(self.begins, self.ends - self.threshold + 1), 1)
        np.add.at(out, self.ends + 1, -1)
        return np.cumsum(out[:-1]) == 0

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "left")

    def _grams(self, start: int, stop: int) -> np.ndarray:
        """Names of the strings that stand for windows, for the places in a slice."""
        if self.gram < 8 or self.eight is None:
            part = mixed(self.single[start : stop + self.gram - 1].astype(np.uint64) + np.uint64(1))
            return names(part, self.gram)
        return names(mixed(self.eight[start : stop + self.gram - 8]), self.gram, 8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and names of the strings chosen to stand for the windows they are in."""
        width = self.threshold - self.gram + 1
        fits = self.fits()
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for start in range(0, self.total - self.threshold + 1, SLICE):
            stop = min(start + SLICE, self.total - self.threshold + 1)
            run = self._grams(start, stop + width - 1)
            at = anchors(run, fits[start:stop], width)
            places.append(at + start)
            found.append(run[at])
        at, first = np.unique(np.concatenate(places), return_index=True)
        return at, np.concatenate(found)[first]

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All that windows around the anchors can hold: first and past last place, and a name."""
        document = self.document(at)
        low = np.maximum(self.begins[document], at - (self.threshold - self.gram))
        high = np.minimum(self.ends[document], at + self.threshold)
        data, digest = self.data, xxhash.xxh64_intdigest
        spans = zip(low.tolist(), high.tolist(), strict=True)
        run = np.fromiter((digest(data[a:b]) for a, b in spans), np.uint64, len(at))
        return low, high, paired(run, (at - low).astype(np.uint64))

    def ranked(self, at: np.ndarray, step: int) -> np.ndarray:
        """Names of the strings of a step's length: pairs of names of the step before."""
        size = self.steps[step]
        if step:
            half = self.steps[step - 1]
            return paired(self.ranked(at, step - 1), self.ranked(at + size - half, step - 1))
        if size < 8 or self.eight is None:
            run = mixed(self.single[at].astype(np.uint64))
            for o in range(1, size):
                run = paired(run, self.single[at + o].astype(np.uint64))
            return run
        run = mixed(self.eight[at])
        for o in [*range(8, size - 8, 8), size - 8]:
            run = paired(run, self.eight[at + o])
        return run


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and 1 or, for those that are there more than once, 2."""
    distinct, n = np.unique(keys, return_counts=True)
    return distinct, np.minimum(n, 2)


def _repeated(kind: str, keys: np.ndarray, values: np.ndarray, begins: np.ndarray):
    repeated = np.add.reduceat(values, begins) > 1
    return per_key(repeated.astype(np.uint64), begins, len(values)), None


def _earlier(kind: str, keys: np.ndarray, values: np.ndarray, begins: np.ndarray):
    return some_smaller(values, begins), None


def _is_repeated(keys: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """For each key that was sent, in the block's order, what its range answered."""
    return answers[np.unique(keys, return_inverse=True)[1]] > 0


def _starts_earlier(
    keys: np.ndarray, document: np.ndarray, owners: np.ndarray, answers: np.ndarray
) -> np.ndarray:
    """Whether each key (in the order of places) is in a smaller id or before in its document."""
    _, least, which = least_per_key(keys, owners)
    order = np.lexsort((np.arange(len(keys)), document, which))
    again = np.zeros(len(keys), bool)
    same = (which[order][1:] == which[order][:-1]) & (document[order][1:] == document[order][:-1])
    again[order[1:]] = same
    return (answers[which] > 0) | (owners > least[which]) | again


def _unique(places: np.ndarray) -> np.ndarray:
    return np.unique(places).astype(np.int64)


def remove_repeats(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Documents without the bytes of strings that start earlier too.

    (doc_id, n_bytes, removed, kept). Texts are UTF-8 bytes. A byte goes if a
    string of ``threshold`` bytes over it also starts in a document with a smaller
    id, or before in the same one, as the input has it; strings may overlap.
    ``removed`` are the longest runs of bytes that went, ``kept`` the rest, which
    need not be valid UTF-8. Null and empty texts have no bytes. A null id is
    larger than all others; rows that share an id are documents of their own and
    do not remove each other's bytes.

    Ranking every byte of a corpus would move many times the corpus, so positions
    are left out first that provably need no rank:

    1. Every window of ``threshold`` bytes is represented by a string of about half
       of that in it, its anchor, chosen by least hash; equal windows have equal
       anchors. A window whose anchor is unique is unique.
    2. An anchor whose whole surroundings (all windows around it) start earlier too
       needs no more: they go. Others that are the only ones of their anchor cannot
       be equal to anything.

    3. The windows around the rest, the borders of copies, are ranked by prefix
       doubling: the positions they need are sorted by their first quarter of
       ``threshold`` bytes, then by the pairs of ranks at that offset, then at
       twice the offset, up to the threshold. After every round, positions whose
       rank is unique leave. The last round finds the smallest id of each string.

    A rank is the place of a 64-bit name in the order of names, so it is sent as
    the name; two strings are told apart by it. Each round sorts the names of
    all blocks by range and needs one entry per block and name.
    """
    blocks = write_blocks(docs, id_column, text_column)
    ranges = blocks.ranges
    steps = lengths(threshold)
    parts = offsets(steps)

    def tell_anchors(block: Block, mail: Mail) -> Iterator[Message]:
        at, run = Bytes(block, threshold).anchors()
        yield keep("places", pack_sorted(at))
        yield keep("names", run.tobytes())
        yield from send("anchor", *_counted(run), ranges)

    def tell_contexts(block: Block, mail: Mail) -> Iterator[Message]:
        here = Bytes(block, threshold)
        at = unpack_sorted(mail.kept("places")).astype(np.int64)
        run = np.frombuffer(mail.kept("names"), np.uint64)
        repeated = _is_repeated(run, mail.answers("anchor"))
        at, run = at[repeated], run[repeated]
        yield keep("places", pack_sorted(at))
        yield keep("names", run.tobytes())
        _, _, around = here.contexts(at)
        keys, least, _ = least_per_key(around, here.owners[here.document(at)])
        yield from send("context", keys, least, ranges)

    def tell_rest(block: Block, mail: Mail) -> Iterator[Message]:
        here = Bytes(block, threshold)
        at = unpack_sorted(mail.kept("places")).astype(np.int64)
        run = np.frombuffer(mail.kept("names"), np.uint64)
        document = here.document(at)
        _, _, around = here.contexts(at)
        seen = _starts_earlier(around, document, here.owners[document], mail.answers("context"))
        yield keep("seen", pack_sorted(at[seen]))
        yield keep("places", pack_sorted(at[~seen]))
        yield keep("names", run[~seen].tobytes())
        yield from send("rest", *_counted(run[~seen]), ranges)

    def tell_round(step: int):
        def tell(block: Block, mail: Mail) -> Iterator[Message]:
            here = Bytes(block, threshold)
            yield keep("seen", mail.kept("seen"))
            starts = _alive(here, mail, step)
            yield keep("starts", pack_sorted(starts))
            at = _unique(np.concatenate([starts + o for o in parts[step]]))
            run = here.ranked(at, step)
            if step < len(steps) - 1:
                yield from send(f"{step}", *_counted(run), ranges)
            else:
                keys, least, _ = least_per_key(run, here.owners[here.document(at)])
                yield from send(f"{step}", keys, least, ranges)

        return tell

    def _alive(here: Bytes, mail: Mail, step: int) -> np.ndarray:
        """First places of the windows that may still be equal to another one."""
        if step == 0:
            at = unpack_sorted(mail.kept("places")).astype(np.int64)
            run = np.frombuffer(mail.kept("names"), np.uint64)
            at = at[_is_repeated(run, mail.answers("rest"))]
            reach = threshold - here.gram + 1
            low = np.maximum(here.begins[here.document(at)], at - reach + 1)
            near = np.zeros(here.total + 1, np.int32)
            np.add.at(near, low, 1)
            np.add.at(near, at + 1, -1)
            return np.flatnonzero((np.cumsum(near[:-1]) > 0) & here.fits())
        starts = unpack_sorted(mail.kept("starts")).astype(np.int64)
        at = _unique(np.concatenate([starts + o for o in parts[step - 1]]))
        shared = _is_repeated(here.ranked(at, step - 1), mail.answers(f"{step - 1}"))
        for o in parts[step - 1]:
            starts = starts[shared[np.searchsorted(at, starts + o)]]
        return starts

    def cut(block: Block, mail: Mail) -> Iterator[pd.DataFrame]:
        here = Bytes(block, threshold)
        gone = np.zeros(here.total + 1, np.int32)
        low, high, _ = here.contexts(unpack_sorted(mail.kept("seen")).astype(np.int64))
        whole = high - low >= threshold
        np.add.at(gone, low[whole], 1)
        np.add.at(gone, high[whole], -1)
        starts = unpack_sorted(mail.kept("starts")).astype(np.int64)
        last = len(steps) - 1
        document = here.document(starts)
        goes = _starts_earlier(
            here.ranked(starts, last), document, here.owners[document], mail.answers(f"{last}")
        )
        mask = (np.cumsum(gone[:-1]) > 0) | covered(starts[goes], threshold, here.total)
        yield pd.DataFrame(_kept(block, here, mask))

    mail = exchange(blocks, None, tell_anchors, _repeated)
    mail = exchange(blocks, mail, tell_contexts, _earlier)
    mail = exchange(blocks, mail, tell_rest, _repeated)
    for step in range(len(steps)):
        merge = _repeated if step < len(steps) - 1 else _earlier
        mail = exchange(blocks, mail, tell_round(step), merge)
    kept = each_block(blocks, mail, cut, KEPT_BYTES)
    return kept.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _kept(block: Block, here: Bytes, gone: np.ndarray) -> dict[str, list]:
    first, last = runs_of(gone)
    spans: list[list[dict[str, int]]] = [[] for _ in block.lengths]
    owner = here.document(first)
    for d, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
        start = int(here.begins[d])
        spans[d].append({"start": a - start, "end": b - start})
    single = here.single
    texts = [
        single[a:b][~gone[a:b]].tobytes() if s else here.data[a:b]
        for a, b, s in zip(here.begins.tolist(), here.ends.tolist(), spans, strict=True)
    ]
    return {
        "doc_id": block.shown_ids(),
        "n_bytes": block.lengths,
        "removed": spans,
        "kept": texts,
    }
