"""Assignments of many groups at once, and windows cut from blocks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from clipgraph.operators import tracks
from clipgraph.operators.assignment import sparse_transport, transport_groups


@pytest.mark.parametrize("top", [1.0, 3.0])
def test_groups_together_equal_groups_alone(top):
    draw = np.random.default_rng(3)
    rows, cols, cost, supply, demand, of_line, of_right, alone = [], [], [], [], [], [], [], []
    for g in range(300):
        n, m = draw.integers(1, 5, 2)
        listed = np.argwhere(draw.random((n, m)) < draw.choice([0.3, 0.7, 1.0]))
        if not len(listed):
            listed = np.array([[0, 0]])
        r, c = (np.unique(x, return_inverse=True)[1] for x in listed.T)
        price = np.round(draw.random(len(r)) * top, 1)
        s, d = draw.integers(1, 4, r.max() + 1), draw.integers(1, 4, c.max() + 1)
        alone.append(sparse_transport(r, c, price, s, d))
        rows.append(r + len(of_line)), cols.append(c + len(of_right)), cost.append(price)
        supply.append(s), demand.append(d)
        of_line += [g] * len(s)
        of_right += [g] * len(d)
    every = [np.concatenate(x) for x in (rows, cols, cost, supply, demand)]
    assert transport_groups(*every, np.array(of_line), np.array(of_right)).tolist() == np.concatenate(alone).tolist()
    for r, c, price, s, d, got in zip(rows, cols, cost, supply, demand, alone, strict=True):
        r, c = r - r.min(), c - c.min()
        assert (np.bincount(r, got) <= s).all() and (np.bincount(c, got) <= d).all()
        if len(s) == 1 and len(price) == len(d):  # one line: cheapest first, then the first
            left = int(s[0])
            for k in sorted(range(len(price)), key=lambda k: (price[k], c[k])):
                assert got[k] == min(left, d[c[k]])
                left -= got[k]


def _windows(spark, rows, n_frames, kind="int"):
    df = spark.createDataFrame([(k, t, float(t + 1), n) for k, t, n in rows], f"k int, t_idx {kind}, x double, n int")
    made = tracks.gather_windows(df, ["k"], ["x"], n_frames, 4, 2)
    return made, {(r.k, r.clip_index): [v[0] for v in r.matrix] for r in made.collect()}


@pytest.mark.parametrize("n", [5, 64, 67, 300])
def test_windows_of_every_length(spark, n):
    draw = random.Random(n)
    rows = [(k, t, n) for k in range(3) for t in range(n + 3) if draw.random() < 0.2 or t == k * 90 % n]
    want = {}
    for k in range(3):
        seen = {t for key, t, _ in rows if key == k and t < n}
        for c in range(-(-max(1, n - 3) // 2)):
            want[k, c] = [float(t + 1) if t in seen else 0.0 for t in range(2 * c, min(n, 2 * c + 4))]
    assert _windows(spark, rows, n)[1] == want
    assert _windows(spark, rows, "n", "bigint")[1] == want


def test_windows_move_their_rows_once(spark):
    made, _ = _windows(spark, [(1, 0, 9), (2, 8, 9)], 9)
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
