"""Every query with SQL equals it on the smallest tables; every query runs and names all rows."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from hydrolake.llm.catalog import ORACLES, QUERIES


def view(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    df = E.queries()[name](spark, sf)
    want = view(sf).execute(E.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(want.fetchall(), key=key)


COLUMNS = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_neardup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_language": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_names_every_document(spark, sf, name):
    df = E.queries()[name](spark, sf)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    ids = sorted(r[0] for r in df.select("doc_id").collect())
    assert ids == sorted(r[0] for r in view(sf).execute("SELECT doc_id FROM documents").fetchall())


def test_all_queries_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in E.queries()
