"""Files in and out, and streams against batches."""

import json
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from clipgraph.operators import nms
from clipgraph.sources import annotations, datasets, inventory
from clipgraph.streaming import jobs


def test_scan_documents(spark, tmp_path):
    doc = {"clips": [{"objects": [{"obj_id": "cup_01", "category": "cup", "first_seen_frame": 0, "attributes": ["red"]}], "events": [],
                      "clip_metadata": {"clip_index": 3, "frame_indices": [1, 2], "status": "annotated"}}]}
    (tmp_path / "cam_a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "cam_b.json").write_text(json.dumps({"video_id": "named"}))
    docs = annotations.scan_annotations(spark, str(tmp_path))
    got = {r["video_id"]: r["clips"] for r in docs.collect()}
    assert set(got) == {"cam_a", "named"} and got["named"] == []
    clips = annotations.explode_clips(docs)
    assert clips.first()["clip_index"] == 3
    assert annotations.explode_objects(clips).first()["obj_id"] == "cup_01"


def test_documents_per_video(spark, tmp_path):
    docs = spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "video_id string, part bigint, num_clips int")
    annotations.write_annotation_docs(docs, str(tmp_path / "d"), per_video=True)
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if p.is_dir()) == ["video_id=a", "video_id=b"]
    assert annotations.scan_annotations(spark, str(tmp_path / "d"), multi_line=False).count() == 2


def test_media_listing(spark, tmp_path):
    for name in ("a.mp4", "b.AVI", "c.txt", "sub/d.mov"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"123")
    flat = inventory.media_files(inventory.list_files(spark, str(tmp_path)))
    deep = inventory.media_files(inventory.list_files(spark, str(tmp_path), recursive=True), inventory.MEDIA_RECURSIVE)
    assert sorted(r["stem"] for r in flat.collect()) == ["a", "b"]
    assert sorted(r["stem"] for r in deep.collect()) == ["a", "b", "d"]
    assert "content" not in flat.columns


def test_id_list(spark, tmp_path):
    (tmp_path / "val.txt").write_text("s1\n\n  \ns3\n")
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    got = datasets.sample_list_scan(spark, str(tmp_path / "val.txt"), samples, "sample_id")
    assert sorted(r[0] for r in got.collect()) == ["s1", "s3"]


def test_settling_events_in_steps_equals_greedy():
    rng = np.random.default_rng(1)
    frames, conf = rng.integers(0, 60, 80), rng.random(80)
    order = np.lexsort((np.arange(80), -conf))
    want = []
    for i in order:
        if all(abs(frames[i] - frames[j]) > 3 for j in want):
            want.append(i)
    kept, open_, got, dropped = [], np.array([], dtype=int), [], set()
    for horizon in (*range(0, 64, 5), 1000):
        arrived = np.flatnonzero((frames < horizon) & ~np.isin(np.arange(80), got) & ~np.isin(np.arange(80), list(open_)))
        pool = np.concatenate([open_, [i for i in arrived if i not in dropped]]).astype(int)
        state = jobs.settle_events(frames[pool], conf[pool], pool, np.array(kept, dtype=int), horizon, 3)
        dropped |= set(pool[state == 0])
        got += list(pool[state == 1])
        kept += list(frames[pool[state == 1]])
        open_ = pool[state == -1]
    assert sorted(got) == sorted(want)


def test_stream_suppression_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    start = datetime(2024, 1, 1)
    rows = [(f"k{rng.integers(3)}", start + timedelta(seconds=int(f)), int(f), float(rng.random()), i) for i, f in enumerate(np.sort(rng.integers(0, 120, 150)))]
    schema = "k string, ts timestamp, frame int, confidence double, event_seq bigint"
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame(rows[i * 50:(i + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(source))
    last = [(f"k{i}", start + timedelta(seconds=10_000), 10_000, 0.5, 1000 + i) for i in range(3)]
    later = [("end", start + timedelta(seconds=20_000), 20_000, 0.5, 2000)]
    for extra in (last, later):
        spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    zero = spark.createDataFrame([(start,)], "t timestamp").select(F.unix_seconds("t")).first()[0]
    out = jobs.run_available(jobs.suppress_duplicates(stream, ["k"], "ts", (float(zero), 1.0), "0 seconds"), spark, "t")
    got = {r["event_seq"] for r in out.collect() if r["event_seq"] < 1000}
    batch = nms.suppress_duplicates(spark.createDataFrame(rows, schema), ["k"])
    assert got == {r["event_seq"] for r in batch.collect()}
