"""Whole annotation documents, their compact form, vocabulary files and ordered id lists."""

import json

import pytest
from pyspark.sql import functions as F

from clipgraph import schemas
from clipgraph.operators import encode, validate
from clipgraph.sources import annotations, compact_docs, datasets, vocabulary
from clipgraph.vocab import AXES

FULL = dict.fromkeys(AXES) | {"color": "red"}
DOC = {
    "video_id": "20260101_120000_cam", "video_path": "/videos/\"a\" b.mp4",
    "video_metadata": {"video_start_time": "2026-01-01T12:00:00", "source_fps": 20.0, "target_fps": 1.0, "total_frames": 800,
                       "duration_sec": 40.0, "video_end_time": "2026-01-01T12:00:40"},
    "coverage": {"total_clips": 3, "annotated_clips": 2, "motion_filtered_clips": 1, "clips_with_events": 1, "time_range": "x ~ y",
                 "motion_filtered_ranges": [{"start": "a", "end": "b"}]},
    "num_clips": 3, "validation_stats": {"total_annotations": 3, "total_events_input": 4, "total_events_output": 3, "total_events_discarded": 1,
                                         "discard_rate": 0.25, "total_warnings": 2},
    "clips": [
        {"objects": [{"obj_id": "cup_01", "category": "cup", "first_seen_frame": 3, "attributes": FULL | {"pose": "standé"}},
                     {"obj_id": "person_01", "category": "person", "first_seen_frame": 0, "attributes": dict.fromkeys(AXES)}],
         "events": [{"event_id": "e1", "frame": 4, "action": "take_out", "agent": "person_01", "target": "cup_01", "source": "box_01", "destination": None},
                    {"event_id": "e\"2\\", "frame": 5, "action": "use", "agent": "person_01", "target": None, "source": None, "destination": None},
                    {"event_id": "e3", "frame": 6, "action": "move", "agent": "person_01", "target": None, "source": None, "destination": "cup_01"}],
         "clip_metadata": {"clip_index": 0, "frame_indices": [0, 20, 40, 60], "start_time": "2026-01-01T12:00:00", "end_time": "2026-01-01T12:00:03",
                           "start_offset_sec": 0.0, "end_offset_sec": 3.0, "status": "annotated"}},
        {"objects": [], "events": [],
         "clip_metadata": {"clip_index": 1, "frame_indices": [40, 60, 80, 100], "start_time": "2026-01-01T12:00:02", "end_time": "2026-01-01T12:00:05",
                           "start_offset_sec": 2.0, "end_offset_sec": 5.0, "status": "motion_filtered"}},
        {"objects": [{"obj_id": "cup_01", "category": "mug", "first_seen_frame": 0, "attributes": {a: f"{a} value" for a in AXES}}], "events": [],
         "clip_metadata": {"clip_index": 2, "frame_indices": [81, 90], "start_time": "2026-01-01T12:00:04.050000", "end_time": "2026-01-01T12:00:04.500000",
                           "start_offset_sec": 4.05, "end_offset_sec": 4.5, "status": "annotated"}},
    ],
}
EMPTY = {"video_id": "none", "video_path": None, "video_metadata": None, "coverage": None, "num_clips": 0, "validation_stats": None, "clips": []}


def test_compact_round_trip(spark, tmp_path):
    source = tmp_path / "docs"
    source.mkdir()
    (source / "d.json").write_text("\n".join(json.dumps(d) for d in (DOC, EMPTY)))
    docs = annotations.scan_annotations(spark, str(source), multi_line=False)
    compact_docs.write(compact_docs.encode(docs), str(tmp_path / "compact"))
    texts = {json.loads(r[0])["video_id"]: json.loads(r[0]) for r in spark.read.text(str(tmp_path / "compact")).collect()}
    short = texts[DOC["video_id"]]
    assert short["format_version"] == 1 and short["frame_index_params"] == {"step": 20, "stride": 40, "length": 4}
    assert short["object_defs"] == {"cup_01": "cup", "person_01": "person"} and len(short["attribute_profiles"]) == 3
    assert short["clips"][0]["o"] == [["cup_01", 3, 0], ["person_01", 0, 1]]
    assert short["clips"][0]["e"] == [["e1", 4, "take_out", "person_01", "cup_01", "box_01"], ["e\"2\\", 5, "use", "person_01"],
                                      ["e3", 6, "move", "person_01", None, None, "cup_01"]]
    assert short["clips"][1] == {"i": 1, "s": "m"}
    assert short["clips"][2] == {"i": 2, "s": "a", "o": [["cup_01", 0, 2, "mug"]], "fi": [81, 90]}
    back = {r["video_id"]: json.loads(r["value"]) for r in annotations.to_json(compact_docs.decode(compact_docs.read(spark, str(tmp_path / "compact")))).collect()}
    assert back == {DOC["video_id"]: DOC, "none": EMPTY}


def test_compact_of_other_versions_is_refused(spark, tmp_path):
    (tmp_path / "x.txt").write_text('{"format_version": 9, "video_id": "a", "clips": []}\n')
    with pytest.raises(Exception, match="unknown format version 9"):
        compact_docs.read(spark, str(tmp_path / "x.txt")).collect()


def parts(spark):
    clip = "video_id string, clip_index int, frame_indices array<int>, start_time string, end_time string, start_offset_sec double, end_offset_sec double, status string"
    mark = {"m": "motion_filtered", "a": "annotated"}
    clips = spark.createDataFrame([("v", i, [i], f"s{i}" if i < 6 else "", f"e{i}" if i < 6 else "", 0.0, 1.0, mark[k]) for i, k in enumerate("mmammamm")], clip)
    objects = spark.createDataFrame([("v", 2, 0, "cup_01", "cup", 0, {"color": "red"})],
                                    "video_id string, clip_index int, obj_pos int, obj_id string, category string, first_seen_frame int, attributes map<string,string>")
    events = spark.createDataFrame([("v", 2, 1, "e", 1, "use", "cup_01", None, None, None)],
                                   "video_id string, clip_index int, event_seq int, event_id string, frame int, action string, agent string, target string, source string, destination string")
    return clips, objects, events


def test_whole_documents(spark):
    clips, objects, events = parts(spark)
    videos = spark.sql("select v as video_id, 'p' as video_path, timestamp_ntz'2026-01-01 00:00:00' as start_ts, 29.97002997D as source_fps, 1.0D as target_fps, 900 as total_frames, 30.25D as duration_sec from values ('v'), ('w') t(v)")
    checked = spark.createDataFrame([("v", True, ["w"]), ("v", False, ["w", "x"])], "video_id string, keep boolean, warnings array<string>")
    stats = validate.validation_stats_by(checked, clips.select("video_id"), ["video_id"], spark.createDataFrame([("v",)], "video_id string"))
    docs = annotations.annotation_documents(clips, objects, events, "event_seq", videos, stats)
    assert docs.columns == schemas.ANNOTATION_DOC.names
    got = {r["video_id"]: json.loads(r["value"]) for r in annotations.to_json(docs).collect()}
    assert got["v"]["coverage"] == {"total_clips": 8, "annotated_clips": 2, "motion_filtered_clips": 6, "clips_with_events": 1,
                                    "time_range": "2026-01-01T00:00:00 ~ 2026-01-01T00:00:30",
                                    "motion_filtered_ranges": [{"start": "s0", "end": "e1"}, {"start": "s3", "end": "e4"}]}
    assert got["v"]["video_metadata"] == {"video_start_time": "2026-01-01T00:00:00", "source_fps": 29.97, "target_fps": 1.0, "total_frames": 900,
                                          "duration_sec": 30.2, "video_end_time": "2026-01-01T00:00:30"}
    assert got["v"]["validation_stats"] == {"total_annotations": 8, "total_events_input": 2, "total_events_output": 1, "total_events_discarded": 1,
                                            "discard_rate": 0.5, "total_warnings": 4}
    assert got["v"]["num_clips"] == 8 and [c["clip_metadata"]["clip_index"] for c in got["v"]["clips"]] == list(range(8))
    assert got["w"]["clips"] == [] and got["w"]["num_clips"] == 0 and got["w"]["coverage"]["motion_filtered_ranges"] == []


VOCAB = """
categories: [person, cup]
actions:
  - {name: take_out, requires_source: true, requires_destination: false, description: any}
  - {name: use}
attribute_vocab:
  color: [red, blue]
  size:
    - small
"""


def test_vocabulary_files(spark, tmp_path):
    path = tmp_path / "vocab.yaml"
    path.write_text(VOCAB)
    load = lambda part: [tuple(r) for r in vocabulary.load(spark, str(path), part).collect()]
    assert load("category") == [("person", 0), ("cup", 1), ("unknown", 2)]
    assert load("action") == [("take_out", 0, True, False), ("use", 1, False, False)]
    assert load("attribute") == [("color", "red", 0, 0), ("color", "blue", 0, 1), ("size", "small", 1, 0)]
    # validation, category lookup and attribute checks run on what was loaded
    actions = vocabulary.load(spark, str(path), "action")
    objects = spark.createDataFrame([("c", "cup_01"), ("c", "person_01")], "clip string, obj_id string")
    events = spark.createDataFrame([("c", "e1", "take_out", "person_01", "cup_01", None, None), ("c", "e2", "open", "person_01", None, None, None)],
                                   "clip string, event_id string, action string, agent string, target string, source string, destination string")
    got = {r["event_id"]: (r["keep"], len(r["warnings"])) for r in validate.validate_events(events, objects, actions, "clip").collect()}
    assert got == {"e1": (True, 1), "e2": (False, 1)}
    things = spark.createDataFrame([("cup",), ("fork",)], "category string")
    known = vocabulary.load(spark, str(path), "category")
    assert sorted(r["category_id"] for r in encode.lookup_category(things, known, "category", unknown_id=2).collect()) == [1, 2]
    attrs = vocabulary.attributes_of(vocabulary.load(spark, str(path), "attribute"))
    assert attrs == {"color": ["red", "blue"], "size": ["small"]}
    fixed = validate.fix_attributes(spark.createDataFrame([("cup_01", {"color": "green", "size": "small", "pose": "x"})], "obj_id string, attributes map<string,string>"), attrs)
    row = fixed.first()
    assert row["attributes"] == {"color": None, "size": "small"} and len(row["warnings"]) == 2


@pytest.mark.parametrize(("text", "part", "said"), [
    ("categories: []", "category", "must be a list"),
    ("categories: [a, a]", "category", "a more than once"),
    ("categories: [a, unknown]", "category", "cannot be listed"),
    ("categories: [a, ' ']", "category", "entry 1 is no name"),
    ("actions: [{name: a, requires_source: 1}]", "action", "must be true or false"),
    ("actions: [a]", "action", "list of mappings"),
    ("attribute_vocab: {color: red}", "attribute", "attribute_vocab.color must be a list"),
    ("other: 1", "action", "no part actions"),
    ("[1]", "category", "a mapping of parts"),
    ("{a: [", "category", "neither JSON nor YAML"),
])
def test_wrong_vocabularies(text, part, said):
    with pytest.raises(ValueError, match=said):
        vocabulary.rows(vocabulary.parse(text), part)


def test_wrong_vocabulary_names_its_file(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"categories": ["a", "a"]}')
    with pytest.raises(Exception, match="v.json: categories: a more than once"):
        vocabulary.load(spark, str(tmp_path / "v.json"), "category").collect()
    with pytest.raises(Exception, match="unknown part"):
        vocabulary.load(spark, str(tmp_path / "v.json"), "verbs").collect()


def test_ordered_ids(spark, tmp_path):
    rows = [(f"s{i * 7919 % 5000:05d}", "train" if i % 10 else "val") for i in range(5000)] + [("s00001", "train"), ("z", None), (None, "val")]
    df = spark.createDataFrame(rows, "sample_id string, split string").repartition(5)
    path = str(tmp_path / "ids")
    datasets.write_ordered_ids(df, path, "sample_id", ranges=7)
    for split in ("train", "val"):
        files = sorted((tmp_path / "ids" / f"split={split}").glob("part-*"))
        lines = [x for f in files for x in f.read_text().splitlines()]
        assert lines == sorted(s for s, k in rows if k == split and s)
        got = datasets.read_ordered_ids(spark, path, "sample_id").where(F.col("split") == split).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(len(lines))) and [r["sample_id"] for r in got] == lines
    assert len(list((tmp_path / "ids" / "split=train").glob("part-*"))) > 1
    named = datasets.sample_list_scan(spark, f"{path}/split=val", df.select("sample_id").distinct(), "sample_id")
    assert named.count() == 500
    datasets.write_ordered_ids(df.limit(0), str(tmp_path / "none"), "sample_id")
