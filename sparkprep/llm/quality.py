"""Quality by the perplexity under a modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.blocks import (
    KEPT,
    MESSAGES,
    NULL_ID,
    Block,
    Blocks,
    Mail,
    Message,
    each_block,
    exchange,
    keep,
    pack,
    paired,
    per_key,
    send,
    squeezed,
    told,
    unpack_all,
    write_blocks,
)
from sparkprep.llm.grams import Places, pack_words, unpack_words
from sparkprep.llm.shared import crc_of_id, saved
from sparkprep.session import shuffles_removed

ORDER = 3
# One of so many trusted documents is not learned from, but sets the thresholds.
HELD_BACK = 4
QUANTILE = 0.99
# Bits of the hash of an id that number the bins of a language.
BIN_BITS = 16
# N-grams in a shard of the model.
SHARD_ROWS = 1 << 18

_BEGIN, _END = b" <", b" >"  # no word has a space in it


def _columns(level: int) -> list[str]:
    """The keys of an n-gram: itself, its history, and the same of its shorter ends."""
    return ["k1"] if level == 1 else [f"k{level}", f"c{level}", *_columns(level - 1)]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


class Tokens:
    """The n-grams that end at each word of some texts, the ends of texts included.

    Of a text with more bytes than its entry in ``most`` only the words that are
    whole in so many bytes count, and no end.
    """

    def __init__(
        self, texts: list[str | None], order: int, most: list[int] | None = None
    ) -> None:
        numbers: dict[bytes, int] = {_BEGIN: 0, _END: 1}
        parts = []
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            end = [1]
            if most is not None and len(data) > most[i]:
                # One byte more tells whether the last word is whole.
                data, end = data[: most[i] + 1], []
                data = b"".join(data.rsplit(None, 1)[:-1]) if data[-1:].strip() else data
            words = data.lower().split()
            parts.append([0, *[numbers.setdefault(w, len(numbers)) for w in words], *end])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        tokens = np.fromiter((t for p in parts for t in p), np.int64, int(self.sizes.sum()))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)[tokens]
        starts = np.cumsum(self.sizes) - self.sizes
        self.since = np.arange(len(tokens)) - np.repeat(starts, self.sizes)
        self.runs = [hashes]
        for _ in range(1, order):
            run = self.runs[-1]
            self.runs.append(np.concatenate((run[:1], paired(run[:-1], hashes[1:]))))

    def rows(self) -> pd.DataFrame:
        """Counts of the n-grams of full length, and of shorter ones at a beginning.

        The other shorter ones are the ends of longer ones. The beginning itself
        is only ever a history.
        """
        order = len(self.runs)
        frames = []
        for level in range(1, order + 1):
            if level == order:
                at = np.flatnonzero(self.since >= max(level - 1, 1))
            else:
                at = np.flatnonzero(self.since == level - 1) if level > 1 else np.zeros(0, int)
            _, first, n = np.unique(self.runs[level - 1][at], return_index=True, return_counts=True)
            ends = at[first]
            cells = {"level": np.full(len(ends), level, np.int32), "n": n}
            for name in _columns(order):
                kind, size = name[0], int(name[1:])
                if size > level:
                    cells[name] = np.zeros(len(ends), np.int64)
                elif kind == "k":
                    cells[name] = _signed(self.runs[size - 1][ends])
                else:
                    cells[name] = _signed(self.runs[size - 2][ends - 1])
            frames.append(pd.DataFrame(cells))
        return pd.concat(frames, ignore_index=True)


def _level(table: DataFrame, amount: float, weight: Column, most: Column) -> float:
    """The level at which least(most, weight * level), over all rows, comes to ``amount``.

    As in mixing: the level only rises, each round is one aggregate.
    """
    level = 0.0
    while True:
        full = most <= weight * F.lit(level)
        row = table.agg(
            F.sum(F.when(full, most).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(weight)).alias("weights"),
        ).first()
        following = (amount - row.full) / row.weights if row.weights else level
        if following <= level:
            return level
        level = following


def shares(languages: DataFrame, most: int) -> DataFrame:
    """(lang, size, share): how many of its ``size`` bytes each language may teach.

    Half of ``most`` is dealt equally, the rest in proportion to the sizes, where
    no language counts for more than an eighth of all. No language gets more than
    it has; what one leaves over goes to the others in the same way.
    """
    size = F.col("size").cast("double")
    total = languages.agg(F.sum("size")).first()[0] or 0
    if total <= most:
        return languages.select("lang", "size", F.col("size").alias("share"))
    equal = F.least(size, F.lit(_level(languages, most / 2, F.lit(1.0), size)))
    dealt = languages.agg(F.sum(equal)).first()[0]
    weight, left = F.least(size, F.lit(total / 8)), size - equal
    more = F.least(left, weight * F.lit(_level(languages, most - dealt, weight, left)))
    return languages.select("lang", "size", F.floor(equal + more).cast("bigint").alias("share"))


def sample(docs: DataFrame, most: int) -> DataFrame:
    """What to learn from, ``most`` bytes: (chosen, lang, size, take), ids and bytes.

    ``docs`` has (id, lang, size), size being the bytes of the text. ``take`` of
    the ``size`` bytes of the rows with that id and language are to be learned.

    Texts are taken in the order of a hash of the id until the share of their
    language (see ``shares``) is full, so the choice is random, blind to length and
    the same at every run. The text at which it gets full is taken in part.

    The order is found without sorting a language: bytes are summed in 65,536 bins
    of the hash, and only the bin in which the share gets full is ordered.
    """
    draw = F.xxhash64("id")
    bin_ = (F.shiftright(draw, 64 - BIN_BITS) + (1 << (BIN_BITS - 1))).cast("int")
    rows = docs.where((crc_of_id(F.col("id")) % HELD_BACK != 0) & (F.col("size") > 0))
    rows = rows.select("id", "lang", "size", draw.alias("draw"), bin_.alias("bin"))
    bins = saved(rows.groupBy("lang", "bin").agg(F.sum("size").alias("n")), "bins")
    languages = saved(bins.groupBy("lang").agg(F.sum("n").alias("size")), "languages")
    dealt = saved(shares(languages, most), "shares")
    plan = dealt.select(F.col("lang").alias("its"), "share", (F.col("share") < F.col("size")).alias("cut"))
    mine = F.col("lang").eqNullSafe(F.col("its"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    met = bins.withColumn("upto", upto).join(plan.where("cut"), mine).where("upto > share")
    met = met.groupBy("its", "share").agg(
        F.min("bin").alias("last"), F.min(F.col("upto") - F.col("n")).alias("before")
    )
    whole = plan.where("NOT cut").select(
        "its", "share", F.lit(1 << BIN_BITS).alias("last"), F.lit(0).cast("bigint").alias("before")
    )
    ends = saved(met.unionByName(whole), "ends")
    near = rows.join(ends, mine & (F.col("bin") <= F.col("last")))
    near = near.groupBy("id", "lang", "draw", "bin", "last", "share", "before").agg(
        F.sum("size").alias("size")
    )
    order = Window.partitionBy("lang").orderBy("draw", "id")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.col("share") - F.col("before") - (upto - F.col("size"))
    at_last = near.where("bin = last").withColumn("take", F.least(F.col("size"), room))
    earlier = near.where("bin < last").withColumn("take", F.col("size"))
    taken = earlier.unionByName(at_last).where("take > 0")
    return taken.select(F.col("id").alias("chosen"), "lang", "size", "take")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of a level."""
    rows = counts.where("a <= 4").groupBy("a").agg(F.count(F.lit(1)).alias("t")).collect()
    return _discounts_of({r.a: r.t for r in rows})


def _discounts_of(t: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams have a count of 1 to 4."""
    y = t[1] / (t[1] + 2 * t.get(2, 0)) if t.get(1) else 0.5

    def discount(a: int) -> float:
        raw = a - (a + 1) * y * t.get(a + 1, 0) / t[a] if t.get(a) else a / 2
        return min(max(raw, 0.05), a - 0.05)

    return discount(1), discount(2), discount(3)


class Level(NamedTuple):
    """The model of one n-gram length: counts, histories and discounts."""

    counts: DataFrame  # key, a
    histories: DataFrame  # key, total, left
    discounts: tuple[float, float, float]


def model(texts: DataFrame, order: int = ORDER) -> list[Level]:
    """Interpolated modified Kneser-Ney counts, shortest n-grams first.

    The full length counts occurrences, a shorter n-gram how many different words
    come before it (at a beginning: occurrences). Each count is discounted by one
    of three amounts; what is taken off a history, ``left``, goes to the shorter
    one in proportion to ``total``, the sum of its counts. Each level is grouped
    from the one above it, whose rows carry the keys of their shorter ends, so
    nothing has to be joined to build it. A column ``most``, if there is one, says
    how many bytes of a text are learned.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = list(batch["most"]) if "most" in batch else None
            yield Tokens(list(batch["text"]), order, most).rows()

    columns = _columns(order)
    schema = "level int, n bigint, " + ", ".join(f"{c} bigint" for c in columns)
    parts = texts.mapInPandas(count, schema)
    grams = saved(parts.groupBy("level", *columns).agg(F.sum("n").alias("n")), "grams")
    out: list[Level] = []
    rows = grams.where(F.col("level") == order).select(*columns, F.col("n").alias("a"))
    for level in range(order, 0, -1):
        taken = _discounts(rows)
        a = F.col("a")
        d = F.when(a == 1, taken[0]).when(a == 2, taken[1]).otherwise(taken[2])
        history = F.col(f"c{level}") if level > 1 else F.lit(0).cast("bigint")
        histories = rows.groupBy(history.alias("key")).agg(
            F.sum("a").alias("total"), F.sum(d).alias("left")
        )
        out.insert(0, Level(rows.select(F.col(f"k{level}").alias("key"), "a"), histories, taken))
        if level > 1:
            shorter = _columns(level - 1)
            ends = rows.select(*shorter, F.lit(1).cast("bigint").alias("n"))
            if level - 1 > 1:
                begins = grams.where(F.col("level") == level - 1)
                ends = ends.unionByName(begins.select(*shorter, "n"))
            rows = saved(ends.groupBy(*shorter).agg(F.sum("n").alias("a")), "counts")
    return out


def shards(levels: list[Level]) -> list[tuple]:
    """The model in arrays, (kind, level, shard, keys, values, values), for ``Model``.

    Each partition of a table is cut by ranges of the key; the parts of a range
    are put together where they are used, so the table is not shuffled again.
    """
    number = max(1, -(-levels[-1].counts.count() // SHARD_ROWS))
    schema = "shard int, keys binary, x binary, y binary"
    out: list[tuple] = []

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy(np.int64).view(np.uint64)
            shard = _shard(keys, number)
            x = batch.iloc[:, 1].to_numpy(np.int64).astype(np.uint32)
            y = batch.iloc[:, -1].to_numpy(np.float64).astype(np.float32)
            for at in np.unique(shard).tolist():
                mine = shard == at
                data = [v[mine].tobytes() for v in (keys, x, y)]
                yield pd.DataFrame([[at, *data]], columns=["shard", "keys", "x", "y"])

    for level, parts in enumerate(levels, 1):
        counts = parts.counts.withColumn("none", F.lit(0.0))
        for kind, table in (("count", counts), ("history", parts.histories)):
            rows = table.mapInPandas(cut, schema).collect()
            out += [(kind, level, *r) for r in rows]
        out.append(("discounts", level, 0, parts.discounts, None, None))
    out.append(("shards", 0, number, None, None, None))
    return out


def _shard(keys: np.ndarray, number: int) -> np.ndarray:
    """Which of ``number`` equal ranges of the key space a key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)


class Model:
    """The shards, joined with the n-grams of texts one after the other."""

    def __init__(self, rows: list[tuple], order: int) -> None:
        self.order = order
        self.number = next(r[2] for r in rows if r[0] == "shards")
        self.discounts = {r[1]: np.array([0.0, *r[3]]) for r in rows if r[0] == "discounts"}
        pieces: dict[tuple, list[tuple]] = {}
        for kind, level, shard, keys, x, y in rows:
            if kind in ("count", "history"):
                pieces.setdefault((kind, level, shard), []).append((keys, x, y))
        self.tables = {}
        for place, found in pieces.items():
            keys, x, y = (
                np.concatenate([np.frombuffer(f[i], kind) for f in found])
                for i, kind in enumerate((np.uint64, np.uint32, np.float32))
            )
            sort = np.argsort(keys)
            self.tables[place] = keys[sort], x[sort], y[sort]
        self.words = sum(len(t[0]) for p, t in self.tables.items() if p[:2] == ("count", 1))

    def find(self, kind: str, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both values of each of the sorted keys; 0 where the model has none."""
        x, y = np.zeros(len(keys)), np.zeros(len(keys))
        edges = np.searchsorted(_shard(keys, self.number), np.arange(self.number + 1))
        for shard, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b and (kind, level, shard) in self.tables:
                have, left, right = self.tables[kind, level, shard]
                places = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                known = have[places] == keys[a:b]
                x[a:b][known], y[a:b][known] = left[places[known]], right[places[known]]
        return x, y

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words (the end counts) and log10 probability of each text."""
        tokens = Tokens(texts, self.order)
        nothing = np.zeros(1, np.uint64)
        chance = np.full(len(tokens.since), 1 / (self.words + 1))
        before, before_which = nothing, np.zeros(len(tokens.since), np.int64)
        for level, run in enumerate(tokens.runs, 1):
            keys, which = np.unique(run, return_inverse=True)
            a, _ = self.find("count", level, keys)
            taken = self.discounts[level][np.minimum(a, 3).astype(np.int64)]
            total, left = self.find("history", level, before)
            # The history of a place is what ends at the place before it.
            at = before_which
            if level > 1:
                at = np.concatenate((before_which[:1], before_which[:-1]))
            total, left = total[at], left[at]
            inside = (tokens.since >= level - 1) & (total > 0)
            longer = ((a - taken)[which] + left * chance) / np.where(inside, total, 1)
            chance = np.where(inside, longer, chance)
            before, before_which = keys, which
        if not self.words:
            chance = np.ones(len(tokens.since))
        logs = np.log10(chance)
        logs[tokens.since == 0] = 0
        starts = np.cumsum(tokens.sizes) - tokens.sizes
        if not len(starts):
            return tokens.sizes, logs
        return tokens.sizes - 1, np.add.reduceat(logs, starts)


def _learned_by_sample(
    rows: DataFrame, good: DataFrame, order: int, sample_bytes: int
) -> DataFrame:
    """(doc_id, lang, trusted, n_tokens, log10_prob) under a model of ``sample_bytes`` of text."""
    # The text stays behind: its size is all the sample needs.
    sizes = rows.select(F.col("doc_id").alias("id"), "lang", F.octet_length("text").alias("size"))
    known = sizes.join(good, F.col("id") == F.col("good"), "left_semi")
    chosen = saved(sample(known, sample_bytes), "chosen")
    its = F.col("doc_id").eqNullSafe(F.col("chosen")) & rows["lang"].eqNullSafe(chosen["lang"])
    # Rows that share id and language share what is taken of them.
    most = F.floor(F.octet_length("text") * F.col("take") / F.col("size"))
    learned = rows.join(chosen, its).select("text", most.alias("most")).where("most > 0")
    shared = rows.sparkSession.sparkContext.broadcast(shards(model(learned, order)))

    @F.pandas_udf("n_tokens bigint, log10_prob double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        theirs = Model(shared.value, order)
        for part in texts:
            found = [theirs.score(list(part[i : i + 500])) for i in range(0, len(part), 500)]
            yield pd.DataFrame(
                {
                    "n_tokens": np.concatenate([np.zeros(0, np.int64), *(n for n, _ in found)]),
                    "log10_prob": np.concatenate([np.zeros(0), *(s for _, s in found)]),
                }
            )

    scored = rows.select("doc_id", "lang", judge("text").alias("found")).select(
        "doc_id", "lang", "found.n_tokens", "found.log10_prob"
    )
    return scored.join(good, F.col("doc_id") == F.col("good"), "left").select(
        "doc_id", "lang", F.col("good").isNotNull().alias("trusted"), "n_tokens", "log10_prob"
    )


# --- the model of all trusted text, counts joined by range ----------------

_SCORES = "doc_id string, lang string, trusted boolean, n_tokens bigint, log10_prob double"
# Per n-gram as a history, of the counts of what follows it: the sum of what they are
# beyond 3 each, and how many are 1, 2 and more.
_FOLLOWED = 4
# The ranges of n-grams longer than a word are exchanged in so many parts, one after the
# other, so that only one part of the keys is on disk at a time; those that are histories
# too and have more answers in one part more. Blocks are judged in so many parts.
_PARTS = 2
_BLOCK_BYTES = 12 * 1024**2
# What a block keeps from the first part of a level for the others.
_OWNED = "owned"


def _marks(blocks: Blocks, good: DataFrame) -> DataFrame:
    """Mail that tells each block which of its documents are trusted, and learned from.

    Only ids are joined. The number of a document is its place twice, and one more
    if it is learned from.
    """

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                named = (np.frombuffer(row.flags, np.uint8) & NULL_ID) == 0
                ids = np.frombuffer(row.ids, np.int64)[named]
                number = np.full(len(ids), row.block, np.int64)
                yield pd.DataFrame({"block": number, "place": np.flatnonzero(named), "id": ids})

    ids = blocks.rows.select("block", "ids", "flags").mapInPandas(
        places, "block bigint, place bigint, id bigint"
    )
    learn = (crc_of_id(F.col("good")) % HELD_BACK != 0).cast("bigint")
    found = ids.join(good.select("good", learn.alias("learn")), F.col("id") == F.col("good"))
    number = F.col("place") * 2 + F.col("learn")
    lists = found.groupBy("block").agg(F.array_join(F.collect_list(number.cast("string")), ",").alias("all"))
    rows = lists.selectExpr("0L AS target", "block", "'trusted' AS kind", "encode(all, 'utf-8') AS data")
    return saved(rows.selectExpr(*(c.split()[0] for c in MESSAGES.split(", "))), "trusted")


def _trusted(block: Block, mail: Mail) -> tuple[np.ndarray, np.ndarray]:
    """Which documents of a block are trusted, and which are learned from."""
    out = np.zeros((2, len(block.ids)), bool)
    data = mail.data.get(("trusted", 0), b"")
    numbers = np.array(data.split(b",") if data else [], np.int64)
    out[0, numbers // 2] = True
    out[1, numbers[numbers % 2 == 1] // 2] = True
    return out[0], out[1]


def _places(block: Block) -> Places:
    return Places(*unpack_words(block.text, _END, _BEGIN))


def _parts(ranges: int, level: int, order: int) -> list[tuple[int, int]]:
    """The key space in parts of whole ranges: least key and one past the largest."""
    n = min(_PARTS + (level < order - 1), ranges) if level else 1
    cuts = [(ranges * i // n << 64) // ranges for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _owned(grams: Places, mail: Mail, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of a level end that a block owns, a place of each, and their counts.

    One block owns each n-gram that was learned.
    """
    if (_OWNED, KEPT) in mail.data:
        ends, a = unpack_all(mail.kept(_OWNED))
        return ends.view(np.int64), a.view(np.int64)
    answers = mail.answers(f"{level}")
    own = np.flatnonzero(answers & np.uint64(1))
    counts = np.zeros(len(grams.tokens), np.int64)
    counts[grams.firsts(level)[own]] = answers[own] >> np.uint64(1)
    ends = np.flatnonzero(counts)
    return ends, counts[ends]


def _given(
    grams: Places,
    learned: np.ndarray,
    owned: tuple[np.ndarray, np.ndarray] | None,
    level: int,
    part: tuple[int, int],
) -> tuple[np.ndarray, list[np.ndarray]]:
    """A block's n-grams of a level, and what it adds to their counts, and to them as histories.

    Only those with a key in ``part`` of the key space. ``learned`` marks places. A block
    counts each longer n-gram that it owns for the one that it ends with and the one that
    it begins with. At full length (none owned) it counts what it learns.
    """
    keys, _, which = grams.level(level, *part)
    n = len(keys)

    def counted(at: np.ndarray) -> np.ndarray:
        return np.bincount(at[at >= 0], minlength=n)

    if owned is None:
        return keys, [counted(which[learned & (grams.since >= max(level, 1))])]
    ends, a = owned
    counts = counted(which[ends])
    if level > 0:
        counts += counted(which[learned & (grams.since == level)])
    history = which[ends - 1]
    history, a = history[history >= 0], a[history >= 0]
    # Few counts are above 3, so their sum is told by what it is beyond 3 each.
    followers = np.bincount(history * 3 + np.minimum(a, 3) - 1, minlength=3 * n).reshape(n, 3)
    more = np.flatnonzero(a > 3)
    beyond = np.bincount(history[more], a[more] - 3, n).astype(np.int64)
    return keys, [counts, beyond, *followers.T]


def _summed(
    kind: str, keys: np.ndarray, values: np.ndarray | list[np.ndarray], begins: np.ndarray
) -> tuple[list[np.ndarray], tuple[int, ...]]:
    """Sums per n-gram; that of the counts twice, and one more for the block that owns it.

    Told: how many counts are 1, 2, 3, 4, above 0, and their sum.
    """
    values = values if isinstance(values, list) else [values]
    sums = [np.add.reduceat(v, begins) for v in values]
    out = [per_key(s, begins, len(keys)) for s in sums]
    out[0] = out[0] << np.uint64(1)
    out[0][begins] |= sums[0] > 0
    sizes = [int((sums[0] == k).sum()) for k in (1, 2, 3, 4)]
    return out, (*sizes, int((sums[0] > 0).sum()), int(sums[0].sum()))


def _learned_by_all(docs: DataFrame, good: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, trusted, n_tokens, log10_prob) under the model of all that is learned from.

    From the longest n-grams to single words, an exchange each (or a few, see
    ``_parts``): the blocks send what they add to the counts of the n-grams that they
    have, by ranges of the key, and get back the sums of just those. Blocks hold the
    texts as word numbers, as every pass needs no more of them. The discounts of a level, from six
    sums, are all of the model that the driver or all tasks see.
    """
    blocks = write_blocks(docs, "doc_id", "text", F.lit(False), _BLOCK_BYTES, F.col("lang"), pack_words)
    marks, ranges = _marks(blocks, good), blocks.ranges

    def teller(level: int, part: tuple[int, int], keeps: bool):
        def tell(block: Block, mail: Mail) -> Iterator[Message]:
            grams = _places(block)
            # Null and empty texts teach nothing, not even that a text may be empty.
            learned = np.repeat(_trusted(block, mail)[1] & (block.lengths > 0), grams.sizes)
            owned = _owned(grams, mail, level + 1) if level < order - 1 else None
            keys, given = _given(grams, learned, owned, level, part)
            if owned and keeps:
                yield keep(_OWNED, squeezed(pack(owned[0]) + pack(owned[1])))
            yield from send(f"{level}", keys, given, ranges)

        return tell

    mail, every = marks, marks
    taken: list[np.ndarray] = []
    for level in reversed(range(order)):
        found = []
        first, *more = _parts(ranges, level, order)
        found.append(exchange(blocks, mail, teller(level, first, bool(more)), _summed, tight=True))
        if level < order - 1:
            mail = marks.unionByName(found[0].where(F.col("kind") == _OWNED))
        for part in more:
            found.append(exchange(blocks, mail, teller(level, part, False), _summed, tight=True))
        answers = reduce(DataFrame.unionByName, found)
        *t, words, total = told(answers, f"{level}", 6)
        taken.insert(0, np.array([0.0, *_discounts_of(dict(enumerate(t, 1)))]))
        answers = answers.where(F.col("target") >= 0)
        # Histories are for the judge alone.
        counts = answers.where(F.col("kind") == f"{level}")
        mail, every = marks.unionByName(counts), every.unionByName(answers)
    # Of the empty history: what follows it once, twice and more often are the words.
    root = np.array([t[0], t[1], words - t[0] - t[1]])

    def judge(block: Block, mail: Mail) -> Iterator[pd.DataFrame]:
        grams = _places(block)
        chance = np.full(len(grams.tokens), 1 / (words + 1))
        which = None
        for level in range(order):
            shorter, (_, _, which) = which, grams.level(level)
            at = np.flatnonzero(which >= 0)
            a = (mail.answers(f"{level}") >> np.uint64(1)).astype(np.float64)
            a -= taken[level][np.minimum(a, 3).astype(np.int64)]
            if level == 0:
                sums, left = np.full(len(at), float(total)), np.full(len(at), root @ taken[0][1:])
            else:
                # The history of a place is what ends at the place before it.
                before = shorter[at - 1]
                beyond, *followers = mail.rest(f"{level - 1}", _FOLLOWED)
                left = sum(n * d for n, d in zip(followers, taken[level][1:], strict=True))
                sums = beyond + sum(n * np.uint64(k) for k, n in enumerate(followers, 1))
                sums, left = sums.astype(np.float64)[before], left[before]
            inside = sums > 0
            at, sums, left = at[inside], sums[inside], left[inside]
            chance[at] = (a[which[at]] + left * chance[at]) / sums
        if not words:
            chance = np.ones(len(chance))
        chance[grams.since == 0] = 1
        yield pd.DataFrame(
            {
                "doc_id": block.shown_ids(),
                "lang": block.labels,
                "trusted": _trusted(block, mail)[0],
                "n_tokens": grams.sizes - 1,
                "log10_prob": np.add.reduceat(np.log10(chance), grams.starts),
            }
        )

    found = []
    for part in range(_PARTS):
        mine = F.pmod(F.xxhash64("block"), F.lit(_PARTS)) == part
        some = Blocks(blocks.rows.where(mine), blocks.count)
        with shuffles_removed(docs.sparkSession):
            found.append(saved(each_block(some, every.where(mine), judge, _SCORES), "scores"))
    scored = reduce(DataFrame.unionByName, found)
    return scored.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    order: int = ORDER,
    quantile: float = QUANTILE,
    sample_bytes: int | None = None,
) -> DataFrame:
    """(doc_id, lang, trusted, n_tokens, log10_prob, perplexity, threshold, kept) for every document.

    ``trusted`` holds the ids of trusted documents (its first column). All text of
    three quarters of them trains the model, and every document is scored by its
    whole text: words are lower-cased (A-Z) and cut at white space, the end of a
    text counts as a word. The model stays in ranges of the n-grams' hashes; blocks
    of documents get the counts of just the n-grams that they have.

    If ``sample_bytes`` is given, only so many bytes of trusted text, chosen at
    random and dealt to the languages by ``shares``, are learned from, and that
    model goes to every task whole.

    A document is kept if its perplexity is at most the threshold of its
    language: the ``quantile`` of the perplexities of all trusted documents held
    back from learning. A language without such documents has the threshold over
    all of them; without any, all is kept. Null languages are a language of their
    own; null and empty texts have one token, the end; rows that repeat stay.
    """
    id_, text = qcol(id_column).cast("bigint"), qcol(text_column).cast("string")
    lang = qcol(lang_column).cast("string")
    good = trusted.select(qcol(trusted.columns[0]).cast("bigint").alias("good")).distinct()
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), lang.alias("lang"))
    if sample_bytes is None:
        scored = _learned_by_all(rows, good, order)
    else:
        scored = _learned_by_sample(rows, good, order, sample_bytes)
    surprise = -F.col("log10_prob") / F.col("n_tokens")
    marked = saved(scored.withColumn("perplexity", F.pow(F.lit(10.0), surprise)), "perplexities")
    held = marked.where(F.col("trusted") & (crc_of_id(F.col("doc_id")) % HELD_BACK == 0))
    at = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = held.groupBy(F.col("lang").alias("its")).agg(at.alias("own"))
    overall = held.agg(at.alias("all"))
    judged = marked.join(by_lang, F.col("lang").eqNullSafe(F.col("its")), "left").withColumn(
        "threshold", F.coalesce("own", overall.scalar())
    )
    return judged.select(
        "doc_id",
        "lang",
        "trusted",
        "n_tokens",
        "log10_prob",
        "perplexity",
        "threshold",
        F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"),
    )
