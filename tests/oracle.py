"""Runs a query and its SQL over the same tables and compares columns and values, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(repr([_plain(v[k]) for k in order]) for v in values)


def _plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def difference(spark, query, sql: str, sf: str) -> str:
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = connect(sf).execute(sql)
    want = rows([d[0] for d in out.description], out.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    a, b = set(got[1]), set(want[1])
    return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
