"""Token ids in binary files: a wavelet matrix per shard.

A file is a shard: one row of a Parquet file compressed with zstd, with the bit
planes of its wavelet matrix, the counts ahead of their blocks, and the ids and
lengths of its documents in order. Shards follow each other by (``part``,
``start``), where ``start`` counts the ids of the part ahead of the shard.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.llm.shared import documents, saved
from sparkprep.llm.wavelet import Plane, WaveletMatrix

SHARD_TOKENS = 4 * 1024**2
# Ranges of documents, each with one or more shards; one row for each is sent to all tasks.
MAX_PARTS = 32_768
SLICE_BYTES = 1 << 20
# Bytes of words and their ids that a process remembers, and what each entry takes beside.
CACHE_BYTES, WORD_BYTES = 160 * 1024**2, 150
# Marks that may follow a letter, and the end of the letters that shortcuts are taken for.
MARKS, LETTERS_END = ".,;:!?)", 0x250

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SHARD = (
    "part int, start bigint, n bigint, zeros array<bigint>, planes array<binary>, "
    "ahead array<binary>, doc_ids array<bigint>, lengths array<bigint>"
)
_SHARD_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("start", pa.int64()),
        ("n", pa.int64()),
        ("zeros", pa.list_(pa.int64())),
        ("planes", pa.list_(pa.binary())),
        ("ahead", pa.list_(pa.binary())),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
    ]
)


class Words(dict[bytes, bytes]):
    """Ids of words, encoded when they are first asked for."""

    def __init__(self, encode: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.encode(word)
        self.held += len(word) + len(ids) + WORD_BYTES
        return ids


class Encoder:
    """Ids of texts by a tokenizer that treats what white space separates apart.

    So it is for tokenizers that drop white space and neither join nor look
    across it; each distinct run between white space is encoded once and
    remembered. Three shortcuts are taken if the tokenizer is seen to allow them: one
    form for both cases where capitals are made small letters; a mark behind a
    letter taken as a word of its own; and words of plain letters passed straight
    to the merges, where a run of letters is always one piece.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.levels = max(1, (size - 1).bit_length())
        self.known = Words(self._word)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.encode().lower() for token in added]
        self.merges = self.tokenizer.model
        self.small = self._pieces("AbC") == self._pieces("abc")
        marks = [m for m in MARKS if len(self._pieces(f"a{m}")) == 2 and self._pieces(f"a{m}") == [*self._pieces("a"), *self._pieces(m)]]
        # The mark is looked for first, as that is the faster search.
        self.gap = re.compile(f"[{re.escape(''.join(marks))}](?<=[a-z].)".encode()) if marks else None
        self.letters = self._letters()
        self.plain = re.compile(f"[{''.join(map(chr, self.letters))}]+") if self.letters else None
        # Whether small letters of ASCII go to the merges as they are, and the marks
        # that are pieces of their own behind every letter.
        self.same = all(self.letters.get(i) == chr(i) for i in range(ord("a"), ord("z") + 1))
        ends = {m: self._pieces(m) for m in marks}
        self.marks = {
            m
            for m, pieces in ends.items()
            if all(self._pieces(chr(i) + m) == [piece, *pieces] for i, piece in self.letters.items())
        }

    def _pieces(self, text: str) -> list[str]:
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        split = self.tokenizer.pre_tokenizer
        return [piece for piece, _ in split.pre_tokenize_str(text)] if split else [text]

    def _letters(self) -> dict[int, str]:
        """What the merges get for each Latin letter, if a run of letters is one piece to them."""
        found = {i: self._pieces(chr(i)) for i in range(LETTERS_END) if chr(i).isalpha()}
        single = {i: pieces[0] for i, pieces in found.items() if len(pieces) == 1}
        run = "".join(map(chr, single))
        return single if self._pieces(run) == ["".join(single.values())] else {}

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.same and word.isalpha() and word.islower():
            ids = [t.id for t in self.merges.tokenize(text)]
        elif self.plain and self.plain.fullmatch(text):
            ids = [t.id for t in self.merges.tokenize(text.translate(self.letters))]
        elif text[-1:] in self.marks and self.plain.fullmatch(text, 0, len(text) - 1):
            return self.known[word[:-1]] + self.known[word[-1:]]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.dtype.char, ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, one after the other."""
        return b"".join(map(self._slice, _slices((text or "").encode())))

    def _slice(self, data: bytes) -> bytes:
        if self.known.held > CACHE_BYTES:
            self.known = Words(self._word)
        small = data.lower()
        if any(token in small for token in self.added):
            ids = self.tokenizer.encode(data.decode(), add_special_tokens=False).ids
            return array(self.dtype.char, ids).tobytes()
        words = small if self.small else data
        words = (self.gap.sub(rb" \g<0>", words) if self.gap else words).split()
        return b"".join(map(self.known.__getitem__, words))


@cache
def encoder_of(tokenizer_file: str) -> Encoder:
    """One encoder per process, so that tasks share what was encoded."""
    return Encoder(tokenizer_file)


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of a text of about SLICE_BYTES, cut at white space only."""
    start = 0
    while len(data) - start > SLICE_BYTES and (gap := _SPACE.search(data, start + SLICE_BYTES)):
        yield data[start : gap.start()]
        start = gap.start()
    yield data[start:] if start else data


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    shard_tokens: int = SHARD_TOKENS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write the ids of all texts, ``end_id`` behind each, in ascending order of document.

    Shards have about ``shard_tokens`` ids and at most twice that, but a document
    is never cut: a longer one is a shard of its own. Texts are encoded where
    they are read and the ids written once; only ids are shuffled, by ranges of
    (document id, hash of the ids), so that rows which share an id, or have none,
    are spread too.

    A null text is an empty one (its only id is ``end_id``). Rows without an id
    come first. Rows that share an id follow each other in the order of the
    hash of their ids. Other columns are not kept. A task holds the longest
    text's ids and a shard's planes: about 16 bytes per id.
    """
    known = encoder_of(tokenizer_file)
    dtype, levels = known.dtype, max(known.levels, end_id.bit_length())
    if not 0 <= end_id <= np.iinfo(dtype).max:
        raise ValueError(f"{end_id} does not fit the ids of {tokenizer_file}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = encoder_of(tokenizer_file), np.array([end_id], dtype).tobytes()
        for batch in batches:
            ids = [encoder.encode(t.as_py()) + last for t in batch.column("text")]
            sizes = [len(i) // dtype.itemsize for i in ids]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for name, n, ids in zip(*(batch.column(c) for c in ("doc_id", "n", "ids")), strict=True):
                if names and held + n.as_py() > 2 * shard_tokens:
                    yield _shard(part, start, names, texts, dtype, levels)
                    names, texts, start, held = [], [], start + held, 0
                names.append(name.as_py())
                texts.append(ids.as_py())
                held += n.as_py()
        if names:
            yield _shard(part, start, names, texts, dtype, levels)

    plain = documents(docs, id_column, text_column)
    encoded = saved(plain.mapInArrow(encode, "doc_id bigint, n bigint, ids binary"), "token-ids")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = min(MAX_PARTS, math.ceil(total / shard_tokens) or 1)
    # The rows are written and so have the same places in every attempt.
    placed = encoded.select(
        "*", F.xxhash64("ids").alias("mark"), F.monotonically_increasing_id().alias("place")
    )
    order = "doc_id", "mark", "place"
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = ranged.select("doc_id", "n", "ids").mapInArrow(pack, SHARD)
    # A file per row, so a file per shard.
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def _shard(
    part: int, start: int, names: list, texts: list[bytes], dtype: np.dtype, levels: int
) -> pa.RecordBatch:
    matrix = WaveletMatrix.of(np.frombuffer(b"".join(texts), dtype), levels)
    row = {
        "part": part,
        "start": start,
        "n": matrix.n,
        "zeros": [p.zeros for p in matrix.planes],
        "planes": [p.words.tobytes() for p in matrix.planes],
        "ahead": [p.ahead.tobytes() for p in matrix.planes],
        "doc_ids": names,
        "lengths": [len(t) // dtype.itemsize for t in texts],
    }
    return pa.RecordBatch.from_pylist([row], schema=_SHARD_ARROW)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards, with ``start`` counted over all of them."""
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n").alias("held"))
    # A row per part, MAX_PARTS at most.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    joined = shards.join(F.broadcast(before), "part")
    return joined.withColumn("start", F.col("start") + F.col("before")).drop("before")


def matrix_of(row: dict) -> WaveletMatrix:
    """The wavelet matrix of a row of ``read_shards``."""
    planes = [
        Plane(np.frombuffer(words, np.uint64), np.frombuffer(ahead, np.uint32), zeros)
        for words, ahead, zeros in zip(row["planes"], row["ahead"], row["zeros"], strict=True)
    ]
    return WaveletMatrix(row["n"], planes)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files.

    ``start`` counts the ids of all documents ahead; ``ids`` are little-endian
    32-bit numbers.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = matrix_of(row).all().astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - row["lengths"]
                texts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start"]),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    return read_shards(spark, path).mapInArrow(unpack, schema)


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often these ids come in the files, by rank and without decoding."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = matrix_of(row)
                found = [matrix.count(t) for t in tokens]
                columns = [pa.array(tokens, pa.int64()), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["token", "n"])

    counted = read_shards(spark, path).mapInArrow(count, "token bigint, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of an id, by select; places count from 0 in a document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = matrix_of(row).find(token)
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                document = np.searchsorted(ends, found, side="right")
                places = found - (ends - row["lengths"])[document]
                ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(document))
                yield pa.RecordBatch.from_arrays([ids, pa.array(places)], ["doc_id", "place"])

    return read_shards(spark, path).mapInArrow(find, "doc_id bigint, place bigint")
