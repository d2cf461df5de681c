"""Every query with SQL of its own gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__
from talkspark.plans import following, meetings, registry, stores, transcripts

SF = "/root/testdata/sf0.001"
MODULES = (transcripts, registry, meetings, stores, following)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows, names):
    def show(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        out = con.execute(ORACLES[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == sorted(df.columns)
        assert canon(rows, df.columns) == canon(out.fetchall(), names)
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert os.path.exists(SF)
