"""Every core query runs; those with SQL equal DuckDB's rows."""

import glob
from collections import Counter

import duckdb
import pandas as pd
import pytest

from larkspur.plans import catalog, cleaning, more, search

MODULES = (cleaning, search, catalog, more)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {f.rpartition('/')[2][:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> Counter:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else str(v)

    return Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = df.toPandas()
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        rel = duck.execute(SQL[name])
        want = pd.DataFrame(rel.fetchall(), columns=[c[0] for c in rel.description])
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
