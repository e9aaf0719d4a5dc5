"""The registered queries on the smallest tables, and line dedup against its SQL."""

import os

import pytest

from spoorline.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("SPOORLINE_TABLES", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
COLUMNS = {
    "op1": {"doc_id", "held_out", "lang_pred", "score"},
    "op2": {"doc_id", "held_out", "score", "predicted"},
    "op3": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4": {"query_id", "rank", "doc_id", "score"},
    "op5": {"doc_id", "n_shingles", "component_id"},
    "op6": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op9": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op10": {"doc_id", "n_gone", "kept_chars", "kept_md5"},
    "op11": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op12": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
}


def test_one_query_of_each_number():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(COLUMNS)
    assert set(ORACLE) <= set(QUERIES)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert COLUMNS[name.split("_")[0]] <= set(out.columns)
    assert out.count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for name_ in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{FOLDER}/{name_}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, FOLDER).collect())
    assert got == sorted(cur.fetchall())
