"""Clips that are made of videos dealt out by their id are ranked where they are made."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clipgraph.operators import compact, selection, windows
from clipgraph.plans import catalog
from clipgraph.plans.registry import run

catalog.load()

STEPS = (20, 25, 30, 2)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [(i, i * 7, float(i * 9_000 + 100), dt.datetime(2024, 1, 1 + i % 3)) for i in range(40)]
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/orders.parquet")
    sampled = {i: -(-int(price / 100) // STEPS[i % 4]) for i, _, price, _ in rows}
    return folder, {i: ((n - 16) // 8 + 1, n) for i, n in sampled.items() if n >= 16}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def key(video_id):
    return int(video_id.split("_tp")[1])


def test_middle_clip_moves_videos_only(spark, orders):
    folder, clips = orders
    got = run("middle_clip", spark, folder)
    assert "ENSURE_REQUIREMENTS" not in plan_of(got) and "REPARTITION_BY_NUM" in plan_of(got)
    assert {key(v): (i, n) for v, i, n in map(tuple, got.collect())} == {k: (c // 2, n) for k, (c, n) in clips.items()}


def test_frame_index_params_moves_videos_only(spark, orders):
    folder, clips = orders
    got = run("frame_index_params", spark, folder)
    assert "ENSURE_REQUIREMENTS" not in plan_of(got) and "REPARTITION_BY_NUM" in plan_of(got)
    want = {k: (STEPS[k % 4], STEPS[k % 4] * 8, 16) for k in clips}
    assert {key(v): tuple(rest) for v, *rest in map(tuple, got.collect())} == want


def test_frame_params_ranks_no_lists(spark):
    """Lists of frames are as long as their clips; the sort below the rank holds their sizes and first numbers."""
    clips = spark.range(6).select(F.lit("v").alias("video_id"), F.col("id").alias("clip_index"), F.sequence("id", F.col("id") + 3).alias("frame_indices"))
    got = compact.frame_params(clips, "video_id")
    limits = [x for x in plan_of(got).split("\n") if "Project" in x and "_size" in x]
    assert limits and not any("frame_indices#" in x.split("AS _head")[-1] for x in limits)
    assert [tuple(r) for r in got.collect()] == [("v", 1, 1, 4)]


def test_clips_are_the_same_however_their_videos_lie(spark, monkeypatch):
    monkeypatch.setattr(windows, "_CLIPS_A_PARTITION", 3)
    videos = spark.createDataFrame([("a", 1.0, 70), ("a", 1.0, 40), ("b", 1.0, 9), (None, 1.0, 30), ("c", 1.0, None), ("d", None, 50)],
                                   "video_id string, source_fps double, total_frames int")
    rows = lambda df: sorted(map(str, df.collect()))
    for trailing in ("drop", "keep", "at_least_one"):
        plain, dealt = windows.clip_windows(videos, trailing=trailing), windows.clip_windows(videos, trailing=trailing, by="video_id")
        assert rows(plain) == rows(dealt) and plain.schema == dealt.schema
    assert windows.clip_windows(videos.where("false"), by="video_id").isEmpty()


def test_middle_clip_of_large_videos(spark, monkeypatch):
    """Videos beyond the size of one task have the same middle, with copies of clips and clips without a number."""
    rows = [("a", i) for i in (3, 1, 1, 0, 2, None, 9)] + [("b", 5), ("b", 4), (None, 1)]
    clips = spark.createDataFrame(rows, "video_id string, clip_index int")
    want = [("a", 1), ("b", 5)]
    assert sorted(map(tuple, selection.middle_clip(clips).collect())) == want
    monkeypatch.setattr(selection, "_WHOLE", 1)
    large = selection.middle_clip(clips)
    assert sorted(map(tuple, large.collect())) == want and "hashpartitioning(_at" in plan_of(large)
