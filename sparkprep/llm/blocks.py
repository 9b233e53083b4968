"""Documents in blocks, and exchanges of sorted keys between blocks.

Counting or comparing every word run or byte run of a corpus as a row of its own
would shuffle many times the text. Here a block of some megabytes of text keeps
its runs in arrays, and sends each range of the 64-bit key space what it has
there, as one packed, sorted array with one value per key. The task of a range
merges the arrays of all blocks and answers each block with one value per key,
in the order in which the keys came, so the keys need not travel back. A
key that a large part of all rows has is one entry per block.

A pass is a map over the blocks, a shuffle by range, and a written answer. The
blocks are written once, bucketed, so that answers are joined to them without
moving the text again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.shared import saved
from sparkprep.session import new_path, shuffles_removed

BLOCK_BYTES = 8 * 1024**2
BLOCKS = "block bigint, ids binary, flags binary, lengths binary, text binary, labels binary"
# What ``flags`` holds of a document: whether it is flagged, has no id, has no label.
FLAGGED, NULL_ID, NULL_LABEL = 1, 2, 4
# target: a range of keys, or -1 for what a block keeps for its next pass.
MESSAGES = "target bigint, block bigint, kind string, data binary"
KEPT = -1
# Where documents without an id are in the order of ids: last, with the largest id.
NO_ID = np.iinfo(np.int64).max

# --- arrays as bytes ------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes; the planes that are zero cost nothing."""
    values = np.ascontiguousarray(values, np.uint64)
    top = int(values.max()) if len(values) else 0
    planes = (top.bit_length() + 7) // 8
    table = values.view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + len(values).to_bytes(8, "little") + table.T.tobytes()


def unpack_all(data: bytes) -> list[np.ndarray]:
    """The arrays that were packed one after the other."""
    data, out = memoryview(expanded(data)), []
    while data:
        out.append(unpack(data))
        data = data[9 + data[0] * len(out[-1]) :]
    return out


# What squeezed arrays begin with; packed ones begin with 0 to 8, the number of planes.
SQUEEZED = b"\xff"


def squeezed(data: bytes) -> bytes:
    """Packed arrays in less space: most planes of small numbers are nearly all zero."""
    return SQUEEZED + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expanded(data: bytes) -> bytes:
    """Squeezed arrays as they were; others are left as they are."""
    if data[:1] != SQUEEZED:
        return data
    size = int.from_bytes(data[1:9], "little")
    return pa.decompress(memoryview(data)[9:], size, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    planes, n = data[0], int.from_bytes(data[1:9], "little")
    table = np.zeros((n, 8), np.uint8)
    table[:, :planes] = np.frombuffer(data, np.uint8, planes * n, 9).reshape(planes, n).T
    return table.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers by their differences."""
    values = np.ascontiguousarray(values, np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers scattered over all 64 bits, one to one."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each ordered pair."""
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def pack_sparse(columns: list[np.ndarray]) -> bytes:
    """Columns of which many rows are all zero: which are not, and these."""
    some = np.logical_or.reduce([column != 0 for column in columns])
    bits = np.packbits(some)
    return b"".join(map(pack, (np.array([len(some)]), bits, *(c[some] for c in columns))))


def unpack_sparse(data: bytes) -> list[np.ndarray]:
    n, bits, *found = unpack_all(data)
    some = np.unpackbits(bits.astype(np.uint8), count=int(n[0])).astype(bool)
    out = [np.zeros(len(some), np.uint64) for _ in found]
    for column, values in zip(out, found, strict=True):
        column[some] = values
    return out


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of unsigned numbers in their order, and the numbers in that order.

    Numbers are sorted much faster than places, so the place of each takes its lowest
    bits. The few that differ in those bits only are put in order afterwards.
    """
    n = len(values)
    if n < 2:
        return np.arange(n), values.copy()
    least = values.min()
    spare = 64 - int(values.max() - least).bit_length()
    low = np.uint64((1 << (n - 1).bit_length()) - 1)
    both = values - least
    if 0 < spare < 64:
        both <<= np.uint64(spare)
    both &= ~low
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & low).view(np.int64)
    ranked = values[order]
    wrong = np.flatnonzero(ranked[1:] < ranked[:-1])
    if len(wrong) > 1000:
        order = np.argsort(values)
        return order, values[order]
    for i in wrong.tolist():
        a = int(np.searchsorted(both, both[i] & ~low))
        b = int(np.searchsorted(both, both[i] | low, "right"))
        order[a:b] = order[a:b][np.argsort(ranked[a:b], kind="stable")]
        ranked[a:b] = values[order[a:b]]
    return order, ranked


# --- blocks ---------------------------------------------------------------


@dataclass
class Block:
    """Some documents: ids (NO_ID for null), whether that is so, a flag each, texts as bytes, end to end, and labels."""

    number: int
    ids: np.ndarray
    nulls: np.ndarray
    flags: np.ndarray
    lengths: np.ndarray
    text: bytes
    labels: list[str | None]

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.lengths)

    def texts(self) -> Iterator[bytes]:
        start = 0
        for end in self.ends.tolist():
            yield self.text[start:end]
            start = end

    def shown_ids(self) -> list[str | None]:
        pairs = zip(self.ids.tolist(), self.nulls.tolist(), strict=True)
        return [None if null else str(i) for i, null in pairs]


@dataclass
class Blocks:
    """The written blocks, how many there are, and of how many key ranges."""

    rows: DataFrame
    count: int

    @property
    def ranges(self) -> int:
        return max(1, self.count)


def write_blocks(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    flag: Column | None = None,
    block_bytes: int = BLOCK_BYTES,
    label: Column | None = None,
    held_as: Callable[[list[bytes]], bytes] = b"".join,
) -> Blocks:
    """All documents in blocks of about ``block_bytes``; a longer text is one block.

    A block carries ``label``, a text, of each document with it, and its texts as
    ``held_as`` has them. A null text counts as empty. Blocks are what a task reads in its order; as
    they are written once, later passes see the same ones whatever is lost.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        flags: list[int] = []
        texts: list[bytes] = []
        labels: list[str] = []
        held = 0
        for batch in batches:
            for name, flagged, text, tag in zip(*(batch[c] for c in batch), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if ids and held + len(data) > block_bytes:
                    yield _block_row(first + made, ids, flags, texts, labels, held_as)
                    ids, flags, texts, labels, held, made = [], [], [], [], 0, made + 1
                ids.append(NO_ID if name is None else int(name))
                marks = FLAGGED * bool(flagged) + NULL_ID * (name is None)
                flags.append(marks + NULL_LABEL * (tag is None))
                texts.append(data)
                labels.append(tag or "")
                held += len(data)
        if ids:
            yield _block_row(first + made, ids, flags, texts, labels, held_as)

    rows = docs.select(
        qcol(id_column).cast("bigint").cast("string").alias("doc_id"),
        F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"),
        qcol(text_column).cast("string").alias("text"),
        (label if label is not None else F.lit(None)).cast("string").alias("label"),
    ).mapInPandas(gather, BLOCKS)
    spark = docs.sparkSession
    # A bucketed table in the shared folder; the catalog forgets it at once, the
    # frame keeps the layout.
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = max(8, min(4096, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    writer = rows.write.bucketBy(buckets, "block").option("path", new_path(spark, "llm-blocks"))
    writer.saveAsTable(name, format="parquet", compression="zstd")
    written = spark.table(name)
    count = written.select("block").count()
    spark.sql(f"DROP TABLE {name}")
    return Blocks(written, count)


def _block_row(
    number: int,
    ids: list[int],
    flags: list[int],
    texts: list[bytes],
    labels: list[str],
    held_as: Callable[[list[bytes]], bytes],
) -> pd.DataFrame:
    lengths = np.array([len(t) for t in texts], np.uint64)
    return pd.DataFrame(
        {
            "block": [number],
            "ids": [np.array(ids, np.int64).tobytes()],
            "flags": [np.array(flags, np.uint8).tobytes()],
            "lengths": [pack(lengths)],
            "text": [held_as(texts)],
            "labels": [json.dumps(labels).encode() if any(labels) else b""],
        }
    )


def _block(row) -> Block:
    ids, flags = np.frombuffer(row.ids, np.int64), np.frombuffer(row.flags, np.uint8)
    nulls, flagged = (flags & NULL_ID) != 0, (flags & FLAGGED) != 0
    shown = json.loads(row.labels) if row.labels else [""] * len(ids)
    labels = [None if f & NULL_LABEL else t for f, t in zip(flags.tolist(), shown, strict=True)]
    lengths = unpack(row.lengths).astype(np.int64)
    return Block(int(row.block), ids, nulls, flagged, lengths, row.text, labels)


# --- exchanges ------------------------------------------------------------


class Mail:
    """What the ranges answered a block, and what it kept, by kind."""

    def __init__(self, rows: pd.DataFrame | None) -> None:
        self.data: dict[tuple[str, int], bytes] = {}
        if rows is not None:
            for target, kind, data in zip(rows["target"], rows["kind"], rows["data"], strict=True):
                self.data[kind, int(target)] = data

    def kept(self, kind: str) -> bytes:
        return self.data[kind, KEPT]

    def answers(self, kind: str) -> np.ndarray:
        """One value per key sent, in the order of the keys."""
        parts = sorted((target, data) for (k, target), data in self.data.items() if k == kind)
        return np.concatenate([np.zeros(0, np.uint64), *(unpack(expanded(data)) for _, data in parts)])

    def rest(self, kind: str, n: int) -> list[np.ndarray]:
        """Of a tight pass, the ``n`` values per key sent that came with the first, an array for each."""
        kind += REST
        parts = sorted((target, data) for (k, target), data in self.data.items() if k == kind)
        found = [unpack_sparse(data) for _, data in parts]
        return [np.concatenate([np.zeros(0, np.uint64), *(f[i] for f in found)]) for i in range(n)]


Message = tuple[int, str, bytes]


def send(
    kind: str, keys: np.ndarray, values: np.ndarray | list[np.ndarray] | None, ranges: int
) -> Iterator[Message]:
    """Messages for sorted, distinct keys with a value (or some) each, cut at the key ranges."""
    columns = [] if values is None else values if isinstance(values, list) else [values]
    cuts = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    edges = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    for target, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            data = pack_sorted(keys[a:b])
            body = b"".join(pack(v[a:b]) for v in columns)
            yield target, kind, len(data).to_bytes(8, "little") + data + body


def keep(kind: str, data: bytes) -> Message:
    return KEPT, kind, data


Work = Callable[[Block, Mail], Iterator[Message]]
# What a range does with all that blocks sent to it: kind, keys (sorted), values
# (a list of arrays if several were sent), and where each distinct key begins. Gives
# an answer (or a list of arrays) for each entry, and the sums that are to be told
# of the range, if any.
Values = np.ndarray | list[np.ndarray]
Merge = Callable[[str, np.ndarray, Values, np.ndarray], tuple[Values, tuple[int, ...] | None]]
TOLD = -2
# Ends the kind of the answers of a tight pass after the first.
REST = "+"


def per_key(values: np.ndarray, begins: np.ndarray, total: int) -> np.ndarray:
    """One value per distinct key, repeated for its entries."""
    return np.repeat(values, np.diff(begins, append=total))


def told(answers: DataFrame, kind: str, n: int) -> list[int]:
    """The sums that the ranges told of a kind, added up."""
    texts = answers.where((F.col("target") == TOLD) & (F.col("kind") == kind))
    parts = F.split(F.decode("data", "utf-8"), ",")
    row = texts.agg(*(F.sum(parts[i].cast("bigint")) for i in range(n))).first()
    return [value or 0 for value in row]


def exchange(
    blocks: Blocks, mail: DataFrame | None, work: Work, merge: Merge, tight: bool = False
) -> DataFrame:
    """One pass: every block's messages, merged by range; the answers, written.

    What a block keeps passes through with the answers, so the next pass finds
    both under the block's number. A ``tight`` pass spares disk: messages and answers
    are squeezed, what was shuffled is removed as soon as the answers are written, and
    of several answers to a key all but the first come as another kind (see ``Mail.rest``).
    """
    sent = each_block(blocks, mail, _framed(work, tight), MESSAGES)

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] == KEPT:
            return rows
        out = []
        for kind, part in rows.groupby("kind", sort=False):
            keys, values = [], []
            for data in map(expanded, part["data"]) if tight else part["data"]:
                size = int.from_bytes(data[:8], "little")
                keys.append(unpack_sorted(data[8 : 8 + size]))
                values.append(
                    unpack_all(data[8 + size :]) or [np.zeros(len(keys[-1]), np.uint64)]
                )
            sizes = [len(k) for k in keys]
            every, each = np.concatenate(keys), list(map(np.concatenate, zip(*values, strict=True)))
            del keys, values
            order, every = ordered(every)
            begins = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            each = [column[order] for column in each]
            merged, sums = merge(kind, every, each if len(each) > 1 else each[0], begins)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            found = [column[back] for column in (merged if isinstance(merged, list) else [merged])]
            del merged, each
            if sums is not None:
                out.append((TOLD, KEPT, kind, ",".join(map(str, sums)).encode()))
            edges = np.cumsum([0, *sizes])
            for at, block in enumerate(part["block"]):
                columns = [column[edges[at] : edges[at + 1]] for column in found]
                if not tight:
                    out.append((key[0], block, kind, b"".join(map(pack, columns))))
                    continue
                out.append((key[0], block, kind, squeezed(pack(columns[0]))))
                if len(columns) > 1:
                    out.append((key[0], block, kind + REST, squeezed(pack_sparse(columns[1:]))))
        return pd.DataFrame(out, columns=["target", "block", "kind", "data"])

    # What is kept has no range; a part of the block's number spreads it.
    spread = F.when(F.col("target") == KEPT, F.col("block")).otherwise(F.lit(KEPT))
    answers = sent.groupBy("target", spread.alias("spread")).applyInPandas(answer, MESSAGES)
    if not tight:
        return saved(answers, "answers")
    with shuffles_removed(blocks.rows.sparkSession):
        return saved(answers, "answers")


def _framed(work: Work, tight: bool):
    def run(block: Block, mail: Mail) -> Iterator[pd.DataFrame]:
        for target, kind, data in work(block, mail):
            if tight and target != KEPT:
                data = squeezed(data)
            yield pd.DataFrame(
                {"target": [target], "block": [block.number], "kind": [kind], "data": [data]}
            )

    return run


def each_block(
    blocks: Blocks,
    mail: DataFrame | None,
    work: Callable[[Block, Mail], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """The rows that ``work`` gives for every block and its mail."""
    if mail is None:

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    yield from work(_block(row), Mail(None))

        return blocks.rows.mapInPandas(alone, schema)

    def joined(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [p for row in left.itertuples() for p in work(_block(row), Mail(right))]
        return pd.concat(parts, ignore_index=True) if parts else _nothing(schema)

    return (
        blocks.rows.groupBy("block")
        .cogroup(mail.groupBy("block"))
        .applyInPandas(joined, schema)
    )


def _nothing(schema: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


# --- runs in arrays -------------------------------------------------------


class Numbers(dict[bytes, int]):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def names(items: np.ndarray, length: int, size: int = 1) -> np.ndarray:
    """One number for each run of ``length`` places, equal for equal runs.

    ``items`` has a number for the ``size`` places from each place on. Runs
    double from there; the last step lets two runs overlap.
    """
    run = items
    while 2 * size <= length:
        run, size = paired(run[: max(0, len(run) - size)], run[size:]), 2 * size
    if size < length:
        rest = length - size
        run = paired(run[: max(0, len(run) - rest)], run[rest:])
    return run


def _over_windows(pick, values: np.ndarray, width: int) -> np.ndarray:
    run, size = values, 1
    while 2 * size <= width:
        run, size = pick(run[: max(0, len(run) - size)], run[size:]), 2 * size
    rest = width - size
    return pick(run[: max(0, len(run) - rest)], run[rest:])


def anchors(values: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Places with the least value in some wanted window of ``width`` places.

    ``wanted`` says it for each window, by its first place. As the choice depends
    on the values in the window only, equal windows have equal anchors.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = np.where(wanted, _over_windows(np.minimum, values, width), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    over = _over_windows(np.maximum, np.concatenate((edge, least, edge)), width)
    return np.flatnonzero((over == values) & (over > 0))


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a run of ``length`` from one of the starts."""
    opened = np.zeros(total + 1, np.int32)
    np.add.at(opened, starts, 1)
    np.add.at(opened, np.minimum(starts + length, total), -1)
    return np.cumsum(opened[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last places of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def ordered_ids(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order; null is last, beside the largest id."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def least_per_key(
    keys: np.ndarray, owners: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least owner of each, and which key each entry has."""
    distinct, which = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, which, owners)
    return distinct, least, which


def some_smaller(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether an entry's value is above the least one of its key."""
    least = np.minimum.reduceat(values, begins)
    return (values > per_key(least, begins, len(values))).astype(np.uint64)
