"""Queries whose table is the first one that a session reads."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

ROOT = Path(__file__).resolve().parent.parent

RUN = """
import sys
from clipgraph.plans import catalog
from clipgraph.plans.registry import run
from clipgraph.session import local_session

catalog.load()
spark = local_session("2", shuffle_partitions=2, memory="1g")
print("result", [tuple(r) for r in run("roundtrip_check", spark, sys.argv[1]).collect()])
"""


def test_roundtrip_check_opens_a_session(tmp_path):
    """Its events get the column numbers that Spark also gives to the variables of a lambda."""
    day = lambda i: 1_704_067_200_000_000 + i * 7_000_000_000
    events = pa.table({
        "event_id": pa.array(range(60), pa.int64()), "ts": pa.array([day(i) for i in range(60)], pa.timestamp("us")),
        "user_id": pa.array([i % 5 for i in range(60)], pa.int64()), "event_type": [("view", "click", "error")[i % 3] for i in range(60)],
        "value": [float(i) for i in range(60)], "props": [f'{{"k": {i}}}' for i in range(60)],
    })
    pq.write_table(events, tmp_path / "events.parquet")
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "result [(0,)]" in done.stdout, done.stderr[-2000:]
