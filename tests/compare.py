"""Run registered queries and their SQL twins side by side and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _bag(df.columns, got), _bag(names, want)
    if a != b:
        return (
            f"rows {len(got)} vs {len(want)}, {sum((a - b).values())} differ; "
            f"columns {sorted(names)}; got {list((a - b))[:2]}; want {list((b - a))[:2]}"
        )
    return None


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from aerostrata import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[8]", extra={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, fn, sql[name], folder)
            else:
                got = fn(spark, folder).collect()
                problem = None if got else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            cause = getattr(error, "java_exception", None)
            while cause is not None:
                print("  cause", cause.toString()[:1500])
                cause = cause.getCause()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {'O' if name in sql else 'R'} {name} "
              f"{time.time() - start:.1f}s {(problem or '')[:2500]}", flush=True)
    print("missing queries:", sorted(set(sql) - set(entry.queries())))
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
