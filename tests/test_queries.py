"""Every registered query of the vector and report operators against its SQL, at the smallest scale."""

import os

import duckdb
import numpy as np
import pytest

from tessel import built_queries, queries as registered  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "part events orders lineitem embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda x: "none" if str(x) in ("None", "nan", "<NA>", "NaT") else f"{float(x):.9g}" if isinstance(x, int | float | np.number) and not isinstance(x, bool | np.bool_) else str(x)
    return sorted(tuple(show(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = registered.queries()[name](spark, DATA).toPandas()
    want = db.execute(registered.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("name", "least"), [("hnsw_recall", 0.85), ("ivfpq_trained_recall", 0.2)])
def test_recall_queries(spark, name, least):
    got = registered.queries()[name](spark, DATA).toPandas()
    assert len(got) == 25 and got["recall"].mean() >= least


def test_graph_recall_is_nine_tenths(spark):
    got = registered.queries()["hnsw_recall"](spark, DATA).toPandas()
    assert len(got) == 25 and got["recall"].mean() >= 0.9
