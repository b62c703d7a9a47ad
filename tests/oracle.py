"""Compare a Spark frame with a DuckDB query as bags of rows."""

import glob
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    return repr(round(float(v), 9)) if isinstance(v, float) else str(v)


def rows_of_sql(c, sql):
    rel = c.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return sorted(rel.columns), sorted(tuple(plain(r[k]) for k in order) for r in rel.fetchall())


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
