"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from tracewell.plans import detection, learned, queries, sources

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = queries.SQL | detection.SQL | learned.SQL | sources.SQL


def same_rows(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    key = lambda row: tuple(map(str, row))
    a, b = (sorted(map(tuple, df[names].astype(object).where(df[names].notna(), None).values.tolist()), key=key) for df in (got, want))
    assert len(a) == len(b)
    assert all(x == y for x, y in zip(a, b)), next((x, y) for x, y in zip(a, b) if x != y)


@pytest.mark.parametrize("query", [q for q in (*queries.QUERIES, *detection.QUERIES, *learned.QUERIES, *sources.QUERIES) if q.__name__ in SQL], ids=lambda q: q.__name__)
def test_query(spark, sf_dir, query):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    same_rows(query(spark, sf_dir).toPandas(), con.execute(SQL[query.__name__]).fetch_df())
