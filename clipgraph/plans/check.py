"""Run registered queries next to their SQL checks and report differences."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from clipgraph.plans import catalog, views
from clipgraph.plans.registry import ORACLES, QUERIES, duck_sql, run


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}") + 0.0
    return x


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(name: str, spark, con, sf_dir: str) -> str:
    """Empty text when both sides agree, else what differs."""
    df = run(name, spark, sf_dir)
    got = df.collect()
    if name not in ORACLES:
        return "" if got else "no rows"
    cur = con.execute(duck_sql(name))
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    types = dict(zip(cols, [str(d[1]) for d in cur.description]))
    odd = {c: (t, types[c]) for c, t in df.dtypes if not _same_type(t, types[c])}
    note = f" types {odd}" if odd else ""
    if a != b:
        return f"rows {len(got)} vs {len(want)}; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}{note}"
    return note and "TYPE" + note


_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "float": "FLOAT", "date": "DATE"}


def _same_type(spark_type: str, duck_type: str) -> bool:
    return _KINDS.get(spark_type, spark_type) == duck_type


def main(argv: list[str]) -> None:
    from clipgraph.session import local_session

    catalog.load()
    sf_dir = argv[0]
    names = [n for n in QUERIES if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            diff = compare(name, spark, con, sf_dir)
        except Exception as e:  # reported, not hidden: the caller sees which query failed
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok'} {name} {time.time() - start:.2f}s {'' if name in ORACLES else '(no sql)'} {diff}", flush=True)
    print(f"{len(names)} queries, {bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
