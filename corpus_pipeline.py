"""Documents to training shards: five stages, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import decontamination, language_id, mixing, sharding, simhash
from sparkprep.llm.shared import crc_of_id, saved
from sparkprep.session import new_path

SHARDS = 24
SEED = 7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that are null or have no letter go."""
    learn = (crc_of_id(F.col("doc_id")) % 5 != 0) & F.col("lang").isNotNull()
    return language_id.determined(docs, learn)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return simhash.representatives(docs, shingle=3, max_bits=2)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, and no shorter item, with the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.uncontaminated(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for, up to three times."""
    return mixing.mixed(docs, seed=SEED)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document went in the shuffled shards, which are written to the shared folder."""
    return sharding.assignment(docs, new_path(spark, "llm-shards"), SHARDS, SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

# Fingerprints, profiles and seeded shuffles are not SQL; tests compare each
# stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
