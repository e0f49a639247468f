"""Run registered queries against their SQL and report differences."""

import math
import os
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql, sf_dir):
    """None when equal, else a short account; the seconds both took."""
    began = time.time()
    df = query(spark, sf_dir)
    ours = df.collect()
    middle = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    took = (middle - began, time.time() - middle)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", took
    a, b = _rows(df.columns, ours), _rows(columns, theirs)
    if a == b:
        return None, took
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} / {len(b)}; only ours {only_a[:2]}; only theirs {only_b[:2]}", took
