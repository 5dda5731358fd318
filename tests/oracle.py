"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import glob
import math

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {p.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    got = connection(sf_dir).execute(sql)
    columns = [c[0] for c in got.description]
    other = rows(columns, got.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != other:
        return f"{len(mine)} and {len(other)} rows; {[x for x in mine if x not in other][:2]} and {[x for x in other if x not in mine][:2]}"
    return ""
