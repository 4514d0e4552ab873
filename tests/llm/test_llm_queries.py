"""The registered queries of this subpackage on the smallest tables: their columns, and their SQL where they have it."""

import glob
import os

import duckdb
import pytest

from granary.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "op1_html_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_vector_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op3_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_context_mixing": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_decontaminate": {"doc_id": "bigint", "item_id": "bigint", "n_errors": "int"},
    "op6_quote_links": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string", "reply_to": "bigint", "thread": "bigint", "depth": "bigint"},
    "op7_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_sentencepiece_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_merkle_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op12_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op13_importance_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    found = queries.queries()[name](spark, SF)
    assert COLUMNS[name].items() <= dict(found.dtypes).items()
    assert found.count() > 0


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found, expected = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    theirs = duck.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, theirs))
