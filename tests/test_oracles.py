"""Every query with an oracle matches it (DuckDB on the same Parquet files),
at the smallest scale so the suite stays quick; scripts/check_oracle.py runs
the same comparison at sf0.01."""
import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF
from scripts.check_oracle import SPARK_TO_DUCKDB, TABLES, rows_of

SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(SQLS[name])
    o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    rel = con.sql(SQLS[name])
    o_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {c: SPARK_TO_DUCKDB.get(t, t) for c, t in df.dtypes} == o_types
    assert len(s_rows) == len(o_rows)
    assert rows_of(s_cols, s_rows) == rows_of(o_cols, o_rows)
