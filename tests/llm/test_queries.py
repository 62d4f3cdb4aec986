"""Every registered corpus query that has SQL, against DuckDB on the same tables; column names and counts of the others."""

import os

import duckdb
import pytest

from folioforge.llm.oracle import SQL
from folioforge.llm.queries import QUERIES

OTHERS = {"op5_byte_cnn_language": {"doc_id", "held_out", "lang_pred", "score"}, "op9_crf_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op10_log_bilinear_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op7_semi_markov_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}}


def plain(v):
    return "null" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in os.listdir(data):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{data}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, db, name):
    got = QUERIES[name](spark, data)
    rows, found = got.collect(), db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == expected


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_a_row_for_each_document(spark, data, db, name):
    got = QUERIES[name](spark, data)
    assert set(got.columns) >= OTHERS[name]
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    assert ids == [r[0] for r in db.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
