"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(out, key=repr)


def check(spark, con, fn, sql: str, sf_dir: str) -> tuple[str | None, int, float]:
    """Difference as text (None if equal), row count, seconds in Spark."""
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    dt = time.time() - t
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    gc, gr = rows(df.columns, got)
    wc, wr = rows(want_cols, want)
    if gc != wc:
        return f"columns {gc} != {wc}", len(gr), dt
    if len(gr) != len(wr):
        return f"{len(gr)} rows != {len(wr)}", len(gr), dt
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    # Only a last-digit rounding difference may remain.
    return (f"{len(bad)} rows differ, first {bad[0]} cols {gc}" if bad else None), len(gr), dt
