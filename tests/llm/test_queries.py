"""Registered queries over whole small tables: those with SQL equal it, the others have their columns."""

import pytest

from tests.oracle import connect, difference
from turnwise.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5": "doc_id line_no class_doc class_line kept",
    "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7": "doc_id fingerprint component_id",
    "op8": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9": "doc_id log_weight key rank",
    "op10": "doc_id held_out score predicted",
}


def test_there_is_a_query_for_each_operator():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, key):
    assert difference(spark, connect(SF_DIR), SF_DIR, QUERIES[key], ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_columns_and_rows(spark, key):
    found = QUERIES[key](spark, SF_DIR)
    assert found.columns == COLUMNS[key.split("_")[0]].split()
    rows = found.count()
    ids = found.select("doc_id").distinct().count()
    assert rows >= ids > 100
    if key.split("_")[0] in ("op2", "op6", "op7", "op8", "op10"):
        assert rows == ids == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
