"""Batched model calls, vector aggregates, windows by length, long ramps, and streams that never end."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgraph.functions import arrays
from clipgraph.operators import motion, nms, tracks
from clipgraph.streaming import jobs


def counting(folder):
    """Makes clients that leave a file when they are made and when they are closed, and answer slowly."""
    class Counting:
        def __init__(self, folder):
            import threading
            import uuid

            self.folder, self.lock, self.now, self.peak = Path(folder), threading.Lock(), 0, 0
            self.name = uuid.uuid4().hex
            (self.folder / f"made-{self.name}").touch()

        def __call__(self, request):
            with self.lock:
                self.now += 1
                self.peak = max(self.peak, self.now)
            time.sleep(0.001 * (request["clip"] % 5))
            with self.lock:
                self.now -= 1
            if request["clip"] % 7 == 3:
                raise ValueError(f"bad {request['clip']}")
            if request["clip"] % 7 == 4:
                raise KeyError
            return f"{request['prompt']}|{b''.join(request['frames']).decode()}"

        def close(self):
            (self.folder / f"peak-{self.peak}-{self.name}").touch()

    return lambda: Counting(folder)


def test_batched_model_calls(spark, tmp_path):
    client = counting(str(tmp_path))
    rows = spark.range(200).repartition(3).selectExpr("cast(id as int) as clip", "concat('p', id) as prompt", "array(binary('a'), binary(string(id))) as frames")
    out = motion.annotate_batches(rows, ["clip"], client, ["clip", "prompt", "frames"], most=4)
    got, want = out.collect(), rows.collect()
    assert [r["clip"] for r in got] == [r["clip"] for r in want]  # in the order of the rows
    for r in got:
        if r["clip"] % 7 == 3:
            assert r["raw"] is None and r["error"] == f"bad {r['clip']}"
        elif r["clip"] % 7 == 4:
            assert r["raw"] is None and r["error"] == "KeyError"
        else:
            assert r["raw"] == f"p{r['clip']}|a{r['clip']}" and r["error"] is None
    made = [p.name for p in tmp_path.iterdir() if p.name.startswith("made")]
    peaks = [int(p.name.split("-")[1]) for p in tmp_path.iterdir() if p.name.startswith("peak")]
    assert len(made) == len(peaks) == 3 and 2 <= max(peaks) <= 4
    assert motion.annotate_batches(rows.limit(0), ["clip"], client, ["prompt"]).collect() == []
    with pytest.raises(ValueError):
        motion.annotate_batches(rows, ["clip"], client, ["prompt"], most=0)


def test_moving_clips_in_batches(spark):
    clips = spark.createDataFrame([(1, 5.0, "x"), (2, 0.5, "y")], "clip int, motion_score double, user_prompt string")
    got = motion.annotate_moving(clips, ["clip"], 1.0, client=lambda: (lambda r: r["user_prompt"] * 2)).orderBy("clip").collect()
    assert [(r["raw"], r["inferred"]) for r in got] == [("xx", True), (None, False)]


@pytest.mark.parametrize("dim", [3, 16, 1024])
def test_mean_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    data = [(f"k{i % 3}", rng.random(dim).round(6).tolist()) for i in range(20)]
    got = {r["k"]: r for r in tracks.mean_embedding(spark.createDataFrame(data, "k string, v array<double>"), ["k"], "v", dim).collect()}
    for k in ("k0", "k1", "k2"):
        want = np.mean([v for key, v in data if key == k], axis=0)
        assert np.allclose(got[k]["embedding"], want) and got[k]["n"] == sum(key == k for key, _ in data)


def test_vector_aggregate_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [3.0]), ("b", None), (None, [5.0, 5.0])], "k string, v array<double>")
    got = {r["k"]: tuple(r)[1:] for r in arrays.vector_aggregate(rows, ["k"], "v", 2, F.avg, "m", n=F.count(F.lit(1))).collect()}
    assert got == {"a": ([2.0, 2.0], 2), "b": ([None, None], 1), None: ([5.0, 5.0], 1)}
    plan = tracks.mean_embedding(rows, ["k"], "v", 1024)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan.split("Exchange")[-1] and plan.count("MapInPandas") == 0


def test_windows_by_length(spark):
    rows = spark.createDataFrame([("a", 0, 3, 1.0), ("a", 4, 3, 9.0), ("b", 0, 13, 1.0), ("b", 12, 13, 2.0)], "k string, t_idx int, n int, x double")
    got = {(r["k"], r["clip_index"]): [x for (x,) in r["matrix"]] for r in tracks.gather_windows(rows, ["k"], ["x"], "n", 8, 4).collect()}
    assert got == {("a", 0): [1.0, 0.0, 0.0], ("b", 0): [1.0] + [0.0] * 7, ("b", 1): [0.0] * 8}
    fixed = tracks.gather_windows(rows.where("k = 'b'"), ["k"], ["x"], 16, 8, 4).collect()
    assert sorted(r["clip_index"] for r in fixed) == [0, 1, 2]


def greedy(frames, conf, seq, distance=3):
    kept = []
    for i in np.lexsort((seq, -conf)):
        if all(abs(frames[i] - f) > distance for f in kept):
            kept.append(int(frames[i]))
    return kept


def test_random_suppression(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{k}" if k else None, int(f), float(c), i) for i, (k, f, c) in enumerate(zip(
        rng.integers(0, 6, 1500), rng.integers(0, 250, 1500), rng.integers(0, 20, 1500) / 20, strict=True))]
    df = spark.createDataFrame(rows, "k string, frame int, confidence double, event_seq int")
    got = {}
    for r in nms.suppress_duplicates(df, ["k"]).collect():
        got.setdefault(r["k"], []).append(r["frame"])
    for k in got:
        f, c, s = (np.array(x) for x in zip(*[r[1:] for r in rows if r[0] == k], strict=True))
        assert sorted(got[k]) == sorted(greedy(f, c, s))
    assert nms.suppress_duplicates(df.limit(0), ["k"]).collect() == []


def test_a_ramp_of_a_hundred_thousand_frames(spark):
    n = 100_000
    df = spark.range(n).selectExpr("'v' as k", "cast(id as int) as frame", f"id / {n} as confidence", "id as event_seq")
    began = time.time()
    got = sorted(r["frame"] for r in nms.suppress_duplicates(df, ["k"]).collect())
    assert got == sorted(range(n - 1, -1, -4)) and time.time() - began < 60


def test_settling_a_long_backlog_is_linear():
    rng = np.random.default_rng(9)
    n = 100_000
    frames, conf = rng.permutation(n), rng.random(n)
    began = time.time()
    state = jobs.settle_events(frames, conf, np.arange(n), np.zeros(0, int), n / 2, 3)
    assert time.time() - began < 10
    kept = np.sort(frames[state == 1])
    assert (np.diff(kept) > 3).all() and kept.max() < n / 2 and (frames[state == -1] > n / 2 - 60).all()


def test_a_stream_settles_as_its_watermark_moves(spark, tmp_path):
    """A key that never pauses gives out what is decided after every batch, not at its end."""
    from datetime import datetime, timedelta

    rng = np.random.default_rng(10)
    start = datetime(2024, 1, 1)
    schema = "k string, ts timestamp, frame int, confidence double, event_seq bigint"
    rows = [("k", start + timedelta(seconds=f), f, float(rng.random()), f) for f in range(400)]
    source = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    zero = spark.createDataFrame([(start,)], "t timestamp").select(F.unix_seconds("t")).first()[0]
    out = jobs.run_available(jobs.suppress_duplicates(stream, ["k"], "ts", (float(zero), 1.0), "0 seconds"), spark, "t")
    got = sorted(r["frame"] for r in out.collect())
    f, c, s = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    want = sorted(greedy(f, c, s))
    assert got == want[: len(got)] and len(got) >= len(want) - 4


def test_separation_in_any_unit(spark):
    """Scores do not depend on the unit of the coordinates, and boxes far apart do not meet whatever it is."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        x, y, w, h = *rng.integers(0, 1000, 2), *rng.integers(1, 120, 2)
        rows.append(("v", 0, i, "c", float(x), float(y), float(x + w), float(y + h), 0.5))
    rows.append(("v", 0, 60, "c", 0.0, 0.0, 1000.0, 1000.0, 0.5))  # one box over all others
    schema = "video_id string, frame_index int, track_id int, category string, x1 double, y1 double, x2 double, y2 double, score double"
    df = spark.createDataFrame(rows, schema)
    small = df.withColumns({c: F.col(c) / 1024 for c in ("x1", "y1", "x2", "y2")})
    a, b = ({r["track_id"]: r["match_score"] for r in tracks.separation_scores(d).collect()} for d in (df, small))

    def iou(p, q):
        w, h = min(p[6], q[6]) - max(p[4], q[4]), min(p[7], q[7]) - max(p[5], q[5])
        both = max(w, 0) * max(h, 0)
        return both / ((p[6] - p[4]) * (p[7] - p[5]) + (q[6] - q[4]) * (q[7] - q[5]) - both)

    for p in rows:
        want = (1 - max(iou(p, q) for q in rows if q is not p)) * 0.5
        assert a[p[2]] == pytest.approx(want) and b[p[2]] == pytest.approx(want)
