"""Each query with SQL gives its rows; each query without gives one row for each row of its table."""

import duckdb
import pytest

from tests.test_entry import rows_of
from tidewell.llm.registry import ORACLE_SQL, QUERIES
from tidewell.sources.tables import TABLES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_give_what_their_sql_gives(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    sql = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, sql.fetchall())


@pytest.mark.parametrize("name, source", [("op3_pages", "pages"), ("op4_shard", "documents"), ("op5_bpe", "documents"), ("op7_secrets", "documents"), ("op9_simhash", "documents"), ("op10_quality", "documents"), ("op11_runs", "documents"), ("op12_fertility", "documents")])
def test_queries_keep_every_row(spark, small, name, source):
    assert QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{source}.parquet").count()
