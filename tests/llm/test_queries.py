"""Registered queries: contract columns, and the oracle SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfscope.llm import queries

SF_SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_privacy": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op11_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


def test_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_document(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    assert df.columns == COLUMNS[name]
    documents = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(r.doc_id for r in documents.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_SMALL}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF_SMALL)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
