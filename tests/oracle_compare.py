"""Compare registered queries with their SQL: same columns, same multiset of rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, sum(got.values()), ""
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return False, sum(got.values()), f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return False, sum(got.values()), f"{sum((got - want).values())} extra {extra}; {sum((want - got).values())} missing {missing}"
    return True, sum(got.values()), ""


def main(argv):
    sf_dir = argv[0]
    only = argv[1:]
    from __spark_entry__ import oracle_sql, queries
    from rotaspark.session import local_session

    spark = local_session(8, 8, "10g")
    con = connect(sf_dir)
    checks, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            ok, n, why = compare(spark, con, name, fn, checks.get(name), sf_dir)
        except Exception as exc:  # report and go on
            ok, n, why = False, -1, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += ok is False
        label = {True: "ok", False: "BAD", None: "rows"}[ok]
        print(f"{label:5}{name:32}{n:8} {time.time() - start:6.1f}s {why}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
