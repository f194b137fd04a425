"""Run a query and its DuckDB form over one folder of tables and compare rows, whatever their order."""

import datetime
import decimal
import glob
import os

import duckdb


def shown(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    return repr(v)


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def both(spark, folder, run, sql, con):
    df = run(spark, folder)
    columns = sorted(df.columns)
    got = sorted(",".join(shown(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted(",".join(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    return got, want
