"""Hold a query against its SQL in DuckDB, as sets of rows with columns in the order of their names."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def assert_same(df, con, sql):
    relation = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(x) for x in names]
    got = sorted(tuple(repr(r[x]) for x in names) for r in df.collect())
    want = sorted(tuple(repr(r[i]) for i in at) for r in relation.fetchall())
    assert got == want
