"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, fn, sql, sf_dir) -> list[str]:
    """What differs; empty when both sides agree."""
    df = fn(spark, sf_dir)
    ours = _rows(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = _rows(names, rel.fetchall())
    found = []
    if sorted(df.columns) != sorted(names):
        found.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows vs {len(theirs)}")
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        found.append(f"{len(unequal)} unequal, first {unequal[0]}")
    return found


if __name__ == "__main__":
    import sys

    from oddlines.plans import catalog
    from oddlines.session import local_session

    sf_dir, *only = sys.argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    checks = catalog.checks()
    for name, fn in catalog.queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        try:
            if name in checks:
                found = differences(spark, con, fn, checks[name], sf_dir)
            else:
                found = [f"rows only: {fn(spark, sf_dir).count()}"]
        except Exception as exc:  # report and go on
            found = [f"{type(exc).__name__}: {str(exc)[:600]}"]
        print(f"{name:28s} {time.time() - begin:6.2f}s {'ok' if not found else found}", flush=True)
