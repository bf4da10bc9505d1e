"""Sparse assignment against brute force over single units: optimal, and the first optimum line by line."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgraph.operators import assignment, match


def first_optimum(pairs, supply, demand, missing):
    """Units on each listed pair, by trying every pairing of single units in order."""
    left = [i for i, n in enumerate(supply) for _ in range(n)]
    right = [j for j, n in enumerate(demand) for _ in range(n)]
    whole = {p: round(c * 1e9) for p, c in pairs.items()}
    k, all_listed = min(len(left), len(right)), len(pairs) == len(supply) * len(demand)
    best = None

    def go(i, used, total, path):
        nonlocal best
        if i == len(left):
            n = sum(j < 99 for j in path)
            if all_listed and n < k:
                return
            found = (total + (k - n) * round(missing * 1e9), path)
            best = found if best is None else min(best, found)
            return
        for j, kind in enumerate(right):
            if (left[i], kind) in whole and not used >> j & 1 and not (j and right[j - 1] == kind and not used >> (j - 1) & 1):
                go(i + 1, used | 1 << j, total + whole[left[i], kind], (*path, j))
        go(i + 1, used, total, (*path, 99))

    go(0, 0, 0, ())
    out = {}
    for i, j in enumerate(best[1]):
        if j < 99:
            out[left[i], right[j]] = out.get((left[i], right[j]), 0) + 1
    return out


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_first_optimum(share):
    rng = random.Random(int(share * 10))
    for _ in range(500):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        supply, demand = ([rng.randrange(1, 3) for _ in range(k)] for k in (n, m))
        listed = [(i, j) for i in range(n) for j in range(m) if rng.random() < share]
        if not listed or sum(supply) > 5 or sum(demand) > 5:
            continue
        ties = [0, 0.25, 0.5, 0.75, 1, *([2, 3] if len(listed) == n * m else [])]
        pairs = {p: rng.choice(ties) for p in listed}
        rng.shuffle(listed)
        rows, cols = np.array(listed).T
        units = assignment.sparse_transport(rows, cols, np.array([pairs[p] for p in listed]), np.array(supply), np.array(demand), 1.0)
        assert {p: n for p, n in zip(listed, units.tolist(), strict=True) if n} == first_optimum(pairs, supply, demand, 1.0)


def test_listed_pairs_dearer_than_others():
    rows, cols = np.array([0, 0, 1]), np.array([0, 1, 0])  # (1, 1) is not listed and costs 1
    one = np.ones(2, int)
    assert assignment.sparse_transport(rows, cols, np.array([5.0, 0.5, 0.5]), one, one, 1.0).tolist() == [0, 1, 1]
    assert assignment.sparse_transport(rows, cols, np.array([5.0, 9.0, 9.0]), one, one, 1.0).tolist() == [1, 0, 0]


def test_components():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = rng.integers(1, 30, 2)
        rows, cols = rng.integers(0, n, 25), rng.integers(0, m, 25)
        got = assignment.component_labels(rows, cols, n, m)
        label = list(range(n + m))
        for _ in range(n + m):
            for r, c in zip(rows, cols, strict=True):
                label[r] = label[n + c] = min(label[r], label[n + c])
        want = [label[r] for r in rows]
        assert all((a == b) == (x == y) for a, x in zip(got, want, strict=True) for b, y in zip(got, want, strict=True))


def test_a_video_of_a_hundred_thousand_tracks():
    rng = np.random.default_rng(2)
    n = 100_000
    rows = np.repeat(np.arange(n), 4)
    cols = np.clip(rows + rng.integers(-20, 20, len(rows)), 0, n - 1)
    rows, cols = np.divmod(np.unique(rows * n + cols), n)
    cost = 1 - rng.random(len(rows))
    began = time.time()
    units = assignment.sparse_transport(rows, cols, cost, np.ones(n, int), np.ones(n, int))
    assert time.time() - began < 60
    for side in (rows, cols):
        assert np.bincount(side, units).max() == 1
    # no pair could be added or be swapped in at a gain
    free_left, free_right = np.bincount(rows, units, n) == 0, np.bincount(cols, units, n) == 0
    assert not (free_left[rows] & free_right[cols] & (cost < 1)).any()
    paid = np.zeros(n)
    paid[cols[units > 0]] = cost[units > 0]
    assert not (free_left[rows] & ~free_right[cols] & (cost < paid[cols] - 1e-9)).any()


def test_huge_counts_and_input_order(spark):
    rows = [("g", a, b, c, 3_000_000_000, 2_000_000_000) for a, b, c in [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 0.5)]]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "g string, a int, b int, cost double, na long, nb long")
        got = assignment.assign_groups(df, ["g"], "a", "b", left_n="na", right_n="nb").orderBy("a", "b").collect()
        assert [tuple(r)[1:] for r in got] == [(1, 1, 0.5, 2_000_000_000, 0, 0), (1, 2, 0.5, 1_000_000_000, 2_000_000_000, 0),
                                              (2, 2, 0.5, 1_000_000_000, 0, 1_000_000_000)]


def test_events_of_equal_cost_go_by_order(spark):
    schema = "clip int, id int, action string, frame int, agent_category string, target_category string"
    truth = spark.createDataFrame([(1, 1, "open", 9, "a", "b"), (1, 2, "open", 10, "a", None), (1, 3, "open", 9, "a", "b")], schema)
    pred = spark.createDataFrame([(1, 7, "open", 9, "a", "b"), (1, 6, "open", 9, "a", "b"), (1, 8, "close", 3, "a", None)], schema)
    got = {(r["gt_id"], r["pred_id"]) for r in match.match_events(truth, pred, ["clip"], "id").collect()}
    assert got == {(1, 6), (3, 7), (2, 8)}
    kinds = match.match_event_kinds(truth, pred, ["clip"]).select("gt.*", F.col("pred.frame").alias("to"), "n").collect()
    assert sorted((r["frame"], r["to"], r["n"]) for r in kinds) == [(9, 9, 2), (10, 3, 1)]
    assert match.match_events(truth.limit(0), pred, ["clip"], "id").collect() == []


def test_groups_stay_whole_when_a_join_becomes_a_broadcast(spark):
    """The join is planned over sorted sides and turns into a broadcast at run time, which reads its rows where they lie."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        lines = spark.range(0, 80, 1, 4).select((F.col("id") % 4).alias("g"), F.col("id").alias("a"))
        kinds = spark.range(0, 8, 1, 1).select((F.col("id") % 4).alias("g"), F.col("id").alias("b"))
        costs = lines.join(kinds, "g").withColumn("cost", (F.col("a") * 7 + F.col("b") * 3) % 11 / 11.0)
        solved = assignment.assign_groups(costs, ["g"], "a", "b")
        assert "REPARTITION_BY_NUM" in solved._jdf.queryExecution().executedPlan().toString()
        got = solved.collect()
    finally:
        for k, x in held.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    assert sorted(r["b"] for r in got) == list(range(8))
