"""Runs registered queries beside their SQL twins in DuckDB and tells where they differ."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return list(v) if hasattr(v, "tolist") else v


def differences(spark, f, sql, sf_dir):
    """What is wrong, or None: columns, types (long or double), rows as sorted lists."""
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = connect(sf_dir).sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b} ({cols})" + (f", types {odd}" if odd else "")
    return f"types {odd}" if odd else None
