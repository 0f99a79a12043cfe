"""The operators that SQL can express give the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from llm import queries as Q
from tests.test_oracle import TABLES, same_rows


@pytest.mark.parametrize("name", Q.SQL)
def test_operator(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    same_rows(Q.queries()[name](spark, sf_dir).toPandas(), con.execute(Q.SQL[name]).fetch_df())
