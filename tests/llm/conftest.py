import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) as a frame that has extra columns with clashing names."""

    def make(rows, partitions=3):
        clash = "fp string, root int, node int, u int, block int, shard int, size int, lang string"
        width = len(clash.split(","))
        full = [(i, t) + (None,) * width for i, t in rows]
        return spark.createDataFrame(full, f"doc_id bigint, text string, {clash}").repartition(
            partitions
        )

    return make


@pytest.fixture(scope="session")
def texts(spark):
    """The smallest documents table as a sorted list of (doc_id, text)."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    return sorted(map(tuple, frame.collect()))


ODD = [
    (None, "the end of it all"),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "One"),
    (5, "one"),
    (5, "one"),
    (6, "a b c d e f g"),
    (7, "A B C D E F G"),
    (8, "a b c d e f g"),
    (9, "ÄÖ ß  x é́ 日本 語"),
    (10, "word " * 3000),
]


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, a null id, repeated rows, copies, a long text."""
    return list(ODD)
