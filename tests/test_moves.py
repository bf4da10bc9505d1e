"""Steps that read or move their rows once, on close and far paths alike."""

from __future__ import annotations

import random

from clipgraph.operators import match, tracks


def _boxes(spark, frames: int, per: int):
    draw = random.Random(5)
    rows = []
    for f in range(frames):
        for k in range(per):
            x, y = draw.randrange(0, 300, 10), draw.randrange(0, 300, 10)
            rows.append((1, f, k, "Cat" if k % 2 else "cat", float(x), float(y), float(x + 30), float(y + 40), draw.random()))
    rows += [(1, 0, 900, "cat", None, None, None, None, 0.5), (1, 0, 901, None, 0.0, 0.0, 9.0, 9.0, 0.5), (1, 0, 902, "cat", 5.0, 5.0, None, 9.0, 0.5)]
    return spark.createDataFrame(rows, "video_id int, frame_index int, track_id int, category string, x1 double, y1 double, x2 double, y2 double, score double")


def _moves(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning")


def test_close_boxes_score_like_boxes_in_a_grid(spark, monkeypatch):
    boxes = _boxes(spark, 3, 40)
    near = {(r.frame_index, r.track_id): r.match_score for r in tracks.separation_scores(boxes).collect()}
    monkeypatch.setattr(tracks, "_CLOSE", 0)
    far = {(r.frame_index, r.track_id): r.match_score for r in tracks.separation_scores(boxes).collect()}
    assert near == far and len(near) == 123
    assert near[0, 900] == near[0, 901] == near[0, 902] == 0


def test_boxes_of_a_frame_move_once(spark):
    assert _moves(tracks.separation_scores(_boxes(spark, 3, 8))) == 1


def test_candidates_share_one_key(spark):
    objects = spark.createDataFrame([(1, f"o{i}", "cat", i % 3) for i in range(6)], "video_id int, obj_id string, category string, first_seen_frame int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # objects once for the frames wanted, once for the pairs; boxes once
        assert _moves(match.candidate_pairs(objects, _boxes(spark, 3, 8))) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
