"""Every query of the catalogue against its SQL on DuckDB."""

import duckdb
import pytest

from tripleweave.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in cursor.fetchall()) and got
