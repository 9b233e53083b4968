"""Registered queries of the package: against SQL where there is one, and their columns."""

import sys
from pathlib import Path

import pytest
from conftest import FOLDER

from sparkprep.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

COLUMNS = {
    "op1": "doc_id fingerprint component_id",
    "op2": "doc_id size text_crc32 law shard slot grown_shard",
    "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5": "doc_id size source_size target taken",
    "op6": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9": "doc_id n_words n_removed kept_sha256",
    "op10": "doc_id lang perplexity threshold kept",
    "op11": "doc_id start n_tokens ids_crc32",
    "op12": "item_id rank doc_id score",
    "op13": "lang source part item value rank",
}


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


def test_one_query_per_operator():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, connection, name):
    found = queries.QUERIES[name](spark, FOLDER)
    assert oracle.differences(found, connection, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_columns_and_rows(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(found.columns)
    rows = found.select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
