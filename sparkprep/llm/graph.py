"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """Rows (``node``, ``root``) for every node of ``edges`` (``u``, ``v``: long).

    ``root`` is the smallest node that can be reached. Each round hangs all
    larger neighbours of a node on the smallest one, then all smaller ones, so
    paths shrink by a constant factor and the rounds grow with the logarithm of
    the longest path. Minima are combined before the shuffle and joined back, so
    a node with very many neighbours is no single task; the edges never leave
    the executors, and only a count and a checksum reach the driver.
    """
    stars = saved(_oriented(edges), "edges")
    before = _mark(stars)
    while True:
        stars = saved(_small_star(_large_star(stars)), "edges")
        after = _mark(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _oriented(edges: DataFrame) -> DataFrame:
    larger, smaller = F.greatest("u", "v"), F.least("u", "v")
    return edges.where("u <> v").select(larger.alias("u"), smaller.alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m")
    hung = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())
