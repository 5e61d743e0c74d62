"""Every registered query with an oracle equals DuckDB on the sf0.001 tables (multiset of rows)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from hydrolake.plans.catalog import REGISTRY
from hydrolake.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
KEYS = sorted(k for k in E.oracle_sql() if k in REGISTRY)  # tests/llm has the corpus operators


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


def _norm(v):
    if isinstance(v, float):
        # 1e-9 absolute, then 12 significant digits: sums in another order differ in the last bits
        return "nan" if math.isnan(v) else float(f"{round(v, 9):.12g}")
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    cols = sorted(df.columns)
    spark_rows = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    oracle_rows = Counter(tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert spark_rows == oracle_rows


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["MC_Code", "Hub_ID", "Year"]


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert len(qs) >= 107
