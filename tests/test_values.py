"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from clipgraph import vocab
from clipgraph.functions import arrays, boxes, ids, prompts, sql, times
from clipgraph.operators import compact, decode, encode, graph, match, metrics, motion, tracks, validate, windows


def one(spark, **cols):
    """First row of a frame of expressions."""
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_start_time(spark):
    good = F.lit("20260316_130406_tp00001")
    row = one(spark, a=times.iso(times.parse_start_time(good)), b=times.parse_start_time(F.lit("cam1_20260316")))
    assert row["a"] == "2026-03-16T13:04:06" and row["b"] is None
    with pytest.raises(Exception, match="no start time"):
        one(spark, a=times.parse_start_time(F.lit("bad"), strict=True))


def test_fraction_is_cut_in_iso_and_kept_in_time(spark):
    t = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    row = one(spark, a=times.offset_to_iso(t, F.lit(1.9)), b=F.date_format(times.add_seconds(t, F.lit(1.9)), "ss.SSS"))
    assert row["a"] == "2026-01-01T12:00:01" and row["b"] == "01.900"


def video(spark, frames, fps=20.0):
    return spark.createDataFrame([("20260101_120000_x", fps, frames)], "video_id string, source_fps double, total_frames int")


def test_clip_windows_and_times(spark):
    videos = windows.with_start_time(video(spark, 100))
    clips = windows.clip_timestamps(windows.with_frame_indices(windows.clip_windows(videos, 3, 2))).orderBy("clip_index").collect()
    assert [c["frame_indices"] for c in clips] == [[0, 20, 40], [40, 60, 80]]
    assert clips[0]["end_time"] == "2026-01-01T12:00:02"
    assert (clips[1]["start_offset_sec"], clips[1]["end_offset_sec"]) == (2.0, 4.0)
    assert windows.clip_windows(video(spark, 54200)).count() == 337


@pytest.mark.parametrize("n", range(0, 40))
def test_window_counts_against_loops(spark, n):
    length, stride = 16, 8
    keep, start = 0, 0
    while start < n:
        keep += 1
        if start + length >= n:
            break
        start += stride
    row = one(spark, **{t: windows.window_count(F.lit(n), length, stride, t) for t in ("keep", "drop", "at_least_one")})
    assert row["keep"] == keep
    assert row["drop"] == len([s for s in range(0, n, stride) if s + length <= n])
    assert row["at_least_one"] == len(range(0, max(1, n - length + 1), stride))


def test_half_even_step(spark):
    row = one(spark, a=times.frame_step(F.lit(2.5)), b=times.frame_step(F.lit(3.5)), c=times.frame_step(F.lit(0.2)))
    assert (row["a"], row["b"], row["c"]) == (2, 4, 1)


def test_explode_range_crosses_blocks(spark):
    n = windows._BLOCK * 2 + 3
    df = windows.explode_range(spark.createDataFrame([(n,), (0,)], "n int"), F.col("n"), "i")
    assert df.agg(F.count("i"), F.min("i"), F.max("i"), F.countDistinct("i")).first()[:] == (n, 0, n - 1, n)


def test_clip_status_and_ranges(spark):
    row = one(spark, a=ids.clip_status(F.lit(0), F.lit(0)), b=ids.clip_status(F.lit(None), F.lit(None)), c=ids.clip_status(F.lit(1), F.lit(0)))
    assert (row["a"], row["b"], row["c"]) == ("motion_filtered", "motion_filtered", "annotated")
    for empty, runs in (({2}, 1), ({1, 2, 3}, 1), ({0, 3}, 2)):
        clips = spark.createDataFrame([("v", i, i in empty) for i in range(5)], "video_id string, pos int, static boolean")
        assert windows.filtered_ranges(clips, ["video_id"], "pos", F.col("static")).count() == runs


def test_boxes(spark):
    b = lambda *v: tuple(F.lit(float(x)) for x in v)
    row = one(
        spark, half=boxes.box_iou(b(0, 0, 10, 10), b(5, 5, 15, 15)), same=boxes.box_iou(b(0, 0, 4, 4), b(0, 0, 4, 4)),
        none=boxes.box_iou(b(0, 0, 1, 1), b(5, 5, 6, 6)), empty=boxes.box_iou(b(1, 1, 1, 1), b(1, 1, 1, 1)),
        inside=boxes.box_containment(b(10, 10, 20, 20), b(0, 0, 30, 30)),
        center=F.array(*boxes.to_center(b(0, 0, 320, 240), 640, 480)),
    )
    assert row["half"] == pytest.approx(25 / 175) and row["same"] == 1 and row["none"] == 0 and row["empty"] == 0
    assert row["inside"] == 1 and row["center"] == [0.25, 0.25, 0.5, 0.5]


def test_motion(spark):
    def score(frames):
        rows = [(1, i, len(frames), f) for i, f in enumerate(frames)]
        df = spark.createDataFrame(rows, "clip int, local int, n int, gray array<double>")
        return motion.motion_scores(df, ["clip"], "local", "n").first()["motion_score"]

    still, moved = [10.0] * 4, [30.0] * 4
    assert score([still] * 5) == 0 and score([still]) == 0 and score([still, still]) == 0
    assert score([still, moved]) > 5 and score([still, still, moved, moved, moved]) > 5


def pred_row(spark):
    rows = [
        (0, 0, 2.0, [0.0, 3.0, 0.0], [3.0, 0.0, 0.0], [0.0, 3.0, 0.0], [0.0, 0.0, 0.0, 3.0], [0.0, 0.0, 3.0, 0.0], [0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0]),
        (0, 1, -2.0, [3.0, 0.0, 0.0], [3.0, 0.0, 0.0], [3.0, 0.0, 0.0], [0.0, 0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 3.0], [3.0] + [0.0] * 7),
        (0, 2, 1.5, [0.0, 0.0, 3.0], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 3.0], [0.0] * 5 + [3.0, 0.0, 0.0]),
        (0, 3, -1.0, [3.0, 0.0, 0.0], [3.0, 0.0, 0.0], [3.0, 0.0, 0.0], [0.0, 0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 3.0], [3.0] + [0.0] * 7),
    ]
    heads = ", ".join(f"{h} array<double>" for h in decode.HEADS)
    return spark.createDataFrame(rows, f"sample_id int, q int, interaction double, {heads}")


def test_decoding(spark):
    names = spark.createDataFrame([(0, "pick"), (1, "open"), (2, "place")], "id int, name string")
    slots = decode.slot_literal({0: 10, 1: 20, 2: 30})
    frames = F.array(*[F.lit(i * 5) for i in range(8)])
    out = decode.events_from_predictions(pred_row(spark), slots, 3, names, frames).orderBy("q").collect()
    got = [(e["action"], e["agent_track_id"], e["target_track_id"], e["source_track_id"], e["destination_track_id"], e["frame"]) for e in out]
    assert got == [("open", 10, 20, None, 30, 15), ("place", 20, 30, None, None, 25)]


def objects_df(spark, ids_):
    return spark.createDataFrame([(0, o) for o in ids_], "clip_id int, obj_id string")


def test_event_validation(spark):
    rows = [
        (0, 0, "evt_1", 5, "pick_up", "person_01", "cup_01", "table_01", None),
        (0, 1, "evt_2", 1, "fly", "person_01", "cup_01", None, None),
        (0, 2, "evt_3", 2, "open", "person_01", "ghost_01", None, None),
        (0, 3, "evt_4", 3, "pick_up", "person_01", "cup_01", None, None),
        (0, 4, "evt_5", 4, "open", "person_01", None, None, None),
    ]
    events = spark.createDataFrame(
        rows, "clip_id int, event_seq int, event_id string, frame int, action string, agent string, target string, source string, destination string"
    )
    known = objects_df(spark, ["person_01", "cup_01", "table_01"])
    out = validate.validate_events(events, known, vocab.action_vocab(spark), "clip_id").orderBy("event_seq").collect()
    assert [r["keep"] for r in out] == [True, False, False, True, True]
    assert [len(r["warnings"]) for r in out] == [0, 1, 1, 1, 0]
    assert "requires source" in out[3]["warnings"][0]
    stats = validate.validation_stats(
        validate.validate_events(events, known, vocab.action_vocab(spark), "clip_id"), events.select("clip_id").distinct()
    ).first()
    assert (stats["total_events_input"], stats["total_events_discarded"], stats["discard_rate"]) == (5, 2, 0.4)
    order = validate.order_events(events, "clip_id", "frame", "event_seq")
    assert order.select("resorted").first()[0] is True


def test_attribute_fix(spark):
    df = spark.createDataFrame([("a_1", {"color": "mauve", "shape": "round", "size": None, "state": "open"})], "obj_id string, attributes map<string,string>")
    row = validate.fix_attributes(df).first()
    assert row["attributes"] == {"color": None, "size": None, "state": "open"} and len(row["warnings"]) == 2


@pytest.mark.parametrize(
    "text, valid, n_attr",
    [
        ('{"objects":[{"obj_id":"cup_01","category":"cup","first_seen_frame":0,"attributes":{"color":"red"}}],"events":[]}', True, 1),
        ('{"objects":[{"obj_id":"cup_01","category":"cup","first_seen_frame":0,"attributes":["red"]}],"events":[]}', True, 0),
        ('{"objects":[{"obj_id":"Cup1","category":"cup","first_seen_frame":0}],"events":[]}', False, None),
        ('{"objects":[{"obj_id":"cup_1","category":"cup","first_seen_frame":-1}],"events":[]}', False, None),
        ('{"objects":[],"events":[{"event_id":"e1","frame":0,"action":"use","agent":"cup_1"}]}', False, None),
        ("<think>{}</think>```json\n{\"objects\":[],\"events\":[]}\n```", True, None),
        ("no json", False, None),
    ],
)
def test_parse_and_schema(spark, text, valid, n_attr):
    df = spark.createDataFrame([(text,)], "raw string")
    row = validate.schema_validate(validate.parse_annotation(df, "raw")).first()
    assert row["valid"] is valid
    assert (row["objects"] == []) is (n_attr is None)
    if n_attr is not None:
        assert len(row["objects"][0]["attributes"]) == n_attr


def test_alias_prefers_presence(spark):
    df = spark.createDataFrame([({"agent": None, "agent_id": "x"},), ({"agent_id": "x"},)], "f map<string,string>")
    got = [r[0] for r in df.select(ids.first_present(F.col("f"), ids.ALIASES["agent"])).collect()]
    assert got == [None, "x"]


def test_alignment(spark):
    def run(objects, detections):
        o = spark.createDataFrame(objects, "video_id int, obj_id string, category string, first_seen_frame int")
        d = spark.createDataFrame(detections, "video_id int, frame_index int, track_id int, category string, x1 double, y1 double, x2 double, y2 double, score double")
        mapping = match.align(o, d)
        summary = match.alignment_summary(o, d, mapping).first()
        return {r["obj_id"]: r["track_id"] for r in mapping.collect()}, summary

    box = (0.0, 0.0, 10.0, 10.0)
    objects = [(1, "person_01", "Person", 0), (1, "wrench_01", "wrench", 0)]
    both = [(1, 0, 1, "person", *box, 0.9), (1, 0, 2, "wrench", *box, 0.8)]
    mapping, summary = run(objects, both)
    assert mapping == {"person_01": 1, "wrench_01": 2} and summary["confidence"] == 1.0
    mapping, summary = run(objects, [(1, 0, 1, "car", *box, 0.9)])
    assert mapping == {} and summary["confidence"] == 0 and summary["unmatched_tracks"] == 1
    mapping, summary = run(objects, [both[0], (1, 0, 2, "drawer", *box, 0.8)])
    assert mapping == {"person_01": 1} and (summary["unmatched_objects"], summary["unmatched_tracks"]) == (1, 1)


def test_copies_of_a_box_overlap_fully(spark):
    rows = [(1, 0, t, "cup", 0.0, 0.0, 10.0, 10.0, 0.9) for t in range(3)] + [(1, 0, 9, "cup", 900.0, 900.0, 910.0, 910.0, 0.05)]
    d = spark.createDataFrame(rows, "video_id int, frame_index int, track_id int, category string, x1 double, y1 double, x2 double, y2 double, score double")
    got = {r["track_id"]: r["match_score"] for r in tracks.separation_scores(d).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 9: 0.1}


def test_query_matching_and_losses(spark):
    p = pred_row(spark)
    truth = spark.createDataFrame(
        [(0, 100, 1, 0, 1, None, 2, 3), (0, 101, 2, 1, 2, None, None, 5)],
        "sample_id int, gt_id int, action_class int, agent_track_id int, target_track_id int, source_track_id int, dest_track_id int, event_frame_index int",
    )
    pairs = {r["q"]: r["gt_id"] for r in match.match_queries(p, truth).collect()}
    assert pairs == {0: 100, 2: 101}
    assert metrics.scoring_losses(p, truth.limit(0)).first()["action"] == 0
    assert metrics.action_accuracy(p, truth, pairing="matched").first()[0] == 1.0


def test_metric_registry(spark):
    p = pred_row(spark)
    truth = spark.createDataFrame([(0, 1, 1, 0, 1, None, None, 3)], "sample_id int, gt_id int, action_class int, agent_track_id int, target_track_id int, source_track_id int, dest_track_id int, event_frame_index int")
    with pytest.raises(ValueError, match="unknown metrics"):
        metrics.metric_suite(p, truth, ["nope"])
    metrics.register_metric("n_queries", lambda a, b: a.agg(F.count(F.lit(1)).alias("n")))
    try:
        assert metrics.metric_suite(p, truth, ["n_queries"]).first()["value"] == 4.0
    finally:
        del metrics.METRICS["n_queries"]


def test_graph_f1_edge_cases(spark):
    edges = spark.createDataFrame([(1, "a", 2)], "agent int, action string, target int")
    none = edges.limit(0)
    cols = ["agent", "action", "target"]
    assert metrics.graph_f1(none, none, cols).first()["graph_f1"] == 1.0
    assert metrics.graph_f1(edges, none, cols).first()["graph_f1"] == 0.0
    assert metrics.graph_f1(edges, edges, cols).first()["graph_f1"] == 1.0


def test_graph_queries(spark):
    rows = [
        ("v", 0, "open", 1, 3, None, None, 3, 0.9), ("v", 1, "take_out", 1, 2, 3, None, 5, 0.9), ("v", 2, "place_on", 1, 2, None, 4, 12, 0.9),
    ]
    edges = spark.createDataFrame(
        rows, "video_id string, event_seq int, action string, agent_track_id int, target_track_id int, source_track_id int, destination_track_id int, frame int, confidence double"
    )
    assert graph.object_timeline(edges, 2).count() == 2
    assert graph.events_in_range(edges, 0, 5).count() == 2
    assert graph.current_location(edges).first()["location"] == 4
    nodes = spark.createDataFrame([("v", 1, "person"), ("v", 2, "cup")], "video_id string, track_id int, category string")
    built = graph.build_graph(nodes, graph.number_events(edges, ["frame", "event_seq"]))
    row = built.first()
    assert len(row["nodes"]) == 2 and [e["event_id"] for e in row["edges"]] == ["evt_0000", "evt_0001", "evt_0002"]
    assert '"source_track_id":null' in graph.graph_json(built).first()["json"]


def test_encode_drops_missing_roles(spark):
    events = spark.createDataFrame(
        [(0, 0, 99, "open", "a_1", "b_1", "x_1", None), (0, 1, 3, "open", "a_1", None, None, None), (0, 2, 3, "fly", "a_1", "b_1", None, None)],
        "clip_id int, event_seq int, frame int, action string, agent string, target string, source string, destination string",
    )
    placed = encode.object_index(objects_df(spark, ["a_1", "b_1"]), "clip_id", ["obj_id"])
    row = encode.encode_events(events, placed, vocab.action_vocab(spark), "clip_id").collect()
    assert len(row) == 1 and row[0]["event_frame_index"] == 15 and row[0]["source_track_id"] is None


def test_fixed_vocabularies(spark):
    cats = {r["category"]: r["category_id"] for r in vocab.category_vocab(spark).collect()}
    assert cats["person"] == 0 and cats["case"] == 27 and cats["unknown"] == 28
    acts = {r["action"]: r for r in vocab.action_vocab(spark).collect()}
    assert len(acts) == 13 and acts["move"]["requires_source"] and acts["move"]["requires_destination"]
    assert vocab.attribute_vocab(spark).count() == sum(map(len, vocab.ATTRIBUTES.values()))


def test_prompt_mentions_vocabulary(spark):
    text = prompts.system_prompt()
    assert all(c in text for c in vocab.CATEGORIES) and "- pose: standing" in text
    assert one(spark, p=prompts.user_prompt(F.lit(16), F.lit(1.0)))["p"].startswith("16 frames sampled at 1.0 ")


def test_arrays(spark):
    row = one(
        spark, am=arrays.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))),
        pad=arrays.pad_to(F.array(F.lit(1), F.lit(2)), 4, F.lit(0)), cut=arrays.pad_to(F.array(F.lit(1), F.lit(2)), 1, F.lit(0)),
        mask=arrays.valid_mask(F.lit(2), 3), lsm=F.exp(arrays.log_softmax_at(F.array(F.lit(1000.0), F.lit(1000.0)), F.lit(0))),
    )
    assert row["am"] == 1 and row["pad"] == [1, 2, 0, 0] and row["cut"] == [1] and row["mask"] == [True, True, False]
    assert row["lsm"] == pytest.approx(0.5)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        "select box_iou(array(0D,0D,10D,10D), array(5D,5D,15D,15D)) i, normalize_frame(37, array(0,20,40,60)) n, prf(1L,1L,0L).precision p"
    ).first()
    assert row["i"] == pytest.approx(25 / 175) and row["n"] == 2 and row["p"] == 0.5


def test_single_clip_stride(spark):
    df = spark.createDataFrame([("v", 0, [0, 20, 40, 60]), ("w", 0, [])], "video_id string, clip_index int, frame_indices array<int>")
    row = compact.frame_params(df, "video_id").collect()
    assert len(row) == 1 and (row[0]["step"], row[0]["stride"], row[0]["length"]) == (20, 40, 4)
