"""A query beside its SQL, at full precision."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["documents", "pages", "benchmark", "labels"]


def differences(name: str, spark, sf_dir: str) -> str:
    from clipgraph.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{'/*' if _folder(sf_dir, t) else ''}')")
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a = sorted((tuple(r[c] for c in sorted(cols)) for r in got), key=repr)
    b = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in want), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if u != v and not (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9)):
                return f"{x} vs {y}"
    return ""


def _folder(sf_dir: str, t: str) -> bool:
    import os

    return os.path.isdir(f"{sf_dir}/{t}.parquet")


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from clipgraph.session import local_session

    s = local_session("8")
    s.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:]:
        t0 = time.time()
        print(n, differences(n, s, sys.argv[1]) or "ok", round(time.time() - t0, 1), flush=True)
