"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.columns import qcol
from sparkprep.llm.shared import WORD, fresh, numbered, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Bits of the draw that number the bins of a source, and bits in all.
BIN_BITS = 16
DRAW_BITS = 48


def draw(seed: int, id_column: Column) -> Column:
    """A number of 48 bits that seed and id decide."""
    name = F.concat(F.lit(f"{seed}-"), F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(name, "utf-8")), 1, DRAW_BITS // 4), 16, 10).cast(
        "bigint"
    )


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows (source, weight, source_size).

    The sum of all sizes is shared by weight. Sources above ``max_epochs`` times
    their size are held there, and what is over goes to the others by weight,
    until none is above. The level (share per unit of weight) only rises, so the
    sources held are those whose cap per weight is below it; each round is one
    aggregate and its level the only thing that comes to the driver.
    """
    cap = F.col("source_size") * max_epochs
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        held = cap < F.col("weight") * F.lit(level)
        row = sizes.agg(
            F.sum(F.when(held, cap).otherwise(0)).alias("caps"),
            F.sum(F.when(held, 0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        following = (total - row.caps) / row.weights if row.weights else level
        if following <= level:
            break
        level = following
    return sizes.withColumn(
        "target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    )


def repetitions(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> tuple[DataFrame, str]:
    """The rows with a struct (size, source_size, target, times), and that column's name.

    ``times`` is how often the mix takes the row. ``size`` is the number of words
    (a null text has none). Sources in order of code points, null last, have the
    given weights, over and over. A source is taken as many whole times as its
    target holds, and for the rest its documents in a seeded random order until
    the target is met, the last one if half of it still fits. So the words taken
    miss the target by half a document at most, no document is taken more than
    ``max_epochs`` times, and a rerun takes the same.

    The random order is found without sorting a source: sizes are summed in
    65,536 bins of the draw per source, and only rows in the bin in which the
    target is met are ordered one by one. All others are decided by their source's
    row of the plan alone, so texts are not shuffled. Null sources are a source of
    their own; null ids and repeated rows draw alike and are ordered by size and
    checksum.
    """
    mark, its = fresh(docs, "mark", "its")
    id_, text = qcol(id_column), qcol(text_column).cast("string")
    number = draw(seed, id_)
    marked = docs.withColumn(
        mark,
        F.struct(
            qcol(source_column).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            number.alias("draw"),
            F.shiftright(number, DRAW_BITS - BIN_BITS).cast("int").alias("bin"),
        ),
    )
    narrow = marked.select(f"`{mark}`.source", f"`{mark}`.size", f"`{mark}`.bin")
    bins = saved(narrow.groupBy("source", "bin").agg(F.sum("size").alias("n")), "bins")
    plan = _plan(bins, weights, max_epochs)
    plan = plan.select(F.struct(*plan.columns).alias(its))
    its_ = F.col(its)
    placed = marked.join(plan, F.col(mark)["source"].eqNullSafe(its_["source"]))
    at_last = F.coalesce(F.col(mark)["bin"] == its_["last"], F.lit(False))
    before = F.coalesce(F.col(mark)["bin"] < its_["last"], F.lit(True))
    crc = F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(-1))
    size = F.col(mark)["size"]
    order = Window.partitionBy(its_["source"]).orderBy(F.col(mark)["draw"], id_, size, crc)
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = its_["before"] + upto - size / 2 < its_["need"]
    decided = _with_times(placed.where(~at_last), mark, its, before)
    ordered = _with_times(placed.where(at_last), mark, its, fits)
    return decided.unionByName(ordered).drop(its), mark


def _with_times(placed: DataFrame, mark: str, its: str, extra: Column) -> DataFrame:
    its_ = F.col(its)
    once_more = (extra & (its_["need"] > 0)).cast("int")
    values = F.struct(
        F.col(mark)["size"].alias("size"),
        its_["source_size"].alias("source_size"),
        its_["target"].alias("target"),
        (its_["whole"] + once_more).alias("times"),
    )
    return placed.withColumn(mark, values)


def _plan(bins: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row per source: size, target, whole times, words still wanted and where they are met."""
    sizes = bins.groupBy("source").agg(F.sum("n").alias("source_size"))
    ranked = numbered(sizes, F.col("source").isNull(), F.col("source"))
    cycle = F.lit(list(weights))
    weighted = ranked.select(
        "source", "source_size", cycle[(F.col("rank") % len(weights)).cast("int")].alias("weight")
    )
    plan = targets(saved(weighted, "sources"), max_epochs)
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(F.lit(0))
    plan = plan.select("source", "source_size", "target", whole.cast("bigint").alias("whole"))
    plan = saved(
        plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets"
    )
    its = plan.withColumnRenamed("source", "its")
    mine = F.col("source").eqNullSafe(F.col("its"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
    met = bins.withColumn("upto", upto).join(its, mine).where("upto > need").groupBy("its")
    met = met.agg(F.min("bin").alias("last"), F.min(F.col("upto") - F.col("n")).alias("before"))
    return saved(plan.join(met, mine, "left").drop("its"), "plan")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """How often each document is taken: (doc_id, source, size, source_size, target, times, taken).

    ``taken`` is size times ``times``; for the rest see ``repetitions``.
    """
    rows, mark = repetitions(
        docs, weights, max_epochs, seed, id_column, text_column, source_column
    )
    values = F.col(mark)
    return rows.select(
        qcol(id_column).cast("bigint").alias("doc_id"),
        qcol(source_column).cast("string").alias("source"),
        values["size"].alias("size"),
        values["source_size"].alias("source_size"),
        values["target"].alias("target"),
        values["times"].alias("times"),
        (values["size"] * values["times"]).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = 0, **settings) -> DataFrame:
    """The mix itself: each row, all columns kept, as often as it is taken."""
    rows, mark = repetitions(docs, seed=seed, **settings)
    often = F.explode(F.array_repeat(F.lit(1), F.col(mark)["times"].cast("int")))
    return rows.select(*(qcol(c) for c in docs.columns), often.alias(mark)).drop(mark)
