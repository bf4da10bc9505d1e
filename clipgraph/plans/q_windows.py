"""Clip windows over ordered data (W rows of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from clipgraph.operators import motion, tracks, windows
from clipgraph.operators.ordering import row_index
from clipgraph.plans.q_scalar import clock
from clipgraph.plans.registry import query

_STEP = "cast(greatest(1, round_even(source_fps, 0)) as int)"
_N = f"cast(ceil(total_frames / cast({_STEP} as double)) as int)"
_START = "strptime(substr(video_id, 1, 15), '%Y%m%d_%H%M%S')"


def _window_sql(starts: str) -> str:
    return f"""
select video_id, count(*) as n_clips, cast(sum(least(16, n - s)) as bigint) as sum_length, cast(max(s) as int) as last_start
from (select video_id, n, unnest({starts}) as s from (select *, {_N} as n from v_videos) a) b group by video_id
"""


def _summary(clips):
    return clips.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.sum("length").alias("sum_length"),
        F.max("start_pos").alias("last_start"),
    )


@query("clip_windows_keep", _window_sql("list_filter(range(0, n, 8), lambda s: s = 0 or s - 8 + 16 < n)"))
def clip_windows_keep(v):
    return _summary(windows.clip_windows(v["v_videos"], trailing="keep"))


@query("clip_windows_full", _window_sql("list_filter(range(0, n, 8), lambda s: s + 16 <= n)"))
def clip_windows_full(v):
    return _summary(windows.clip_windows(v["v_videos"], trailing="drop"))


@query("clip_windows_min_one", _window_sql("range(0, greatest(1, n - 16 + 1), 8)"))
def clip_windows_min_one(v):
    return _summary(windows.clip_windows(v["v_videos"], trailing="at_least_one"))


@query("clip_timestamps", f"""
select video_id, count(*) as n_clips, cast(sum(f0) as bigint) as sum_first, cast(sum(f15) as bigint) as sum_last,
  round(max(round(f15 / source_fps, 3)), 3) as max_end_sec, cast(sum(cast(replace(substr(st, 12), ':', '') as bigint)) as bigint) as start_clock, cast(sum(cast(replace(substr(et, 12), ':', '') as bigint)) as bigint) as end_clock,
  round(sum(round(f0 / source_fps, 3)), 3) as sum_start_sec
from (select *, strftime({_START} + to_microseconds(cast(round(f0 / source_fps * 1000000) as bigint)), '%Y-%m-%dT%H:%M:%S') as st,
        strftime({_START} + to_microseconds(cast(round(f15 / source_fps * 1000000) as bigint)), '%Y-%m-%dT%H:%M:%S') as et
      from (select *, start_pos * step as f0, (start_pos + 15) * step as f15 from v_clips) a) b group by video_id
""")
def clip_timestamps(v):
    clips = windows.clip_timestamps(windows.with_frame_indices(windows.clip_windows(windows.with_start_time(v["v_videos"]))))
    return clips.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.sum(F.get("frame_indices", F.lit(0))).alias("sum_first"),
        F.sum(F.get("frame_indices", F.lit(15))).alias("sum_last"),
        F.round(F.max("end_offset_sec"), 3).alias("max_end_sec"),
        F.sum(clock(F.col("start_time"))).alias("start_clock"),
        F.sum(clock(F.col("end_time"))).alias("end_clock"),
        F.round(F.sum("start_offset_sec"), 3).alias("sum_start_sec"),
    )


@query("clip_membership", """
select c.event_id, cast(c.i as int) as clip_index, cast(c.pos - c.i * 8 as bigint) as local
from (select event_id, pos, n, unnest(range(n_clips)) as i
      from (select *, cast(least(1 + ceil(greatest(0, n - 16) / 8.0), ceil(n / 8.0)) as int) as n_clips
            from (select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
                    count(*) over (partition by user_id) as n from events) a) b) c
where c.pos >= c.i * 8 and c.pos < c.i * 8 + 16
""")
def clip_membership(v):
    placed = row_index(v["events"].select("user_id", "ts", "event_id"), ["ts", "event_id"], ["user_id"], name="pos")
    sizes = v["events"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n_clips = windows.window_count(F.col("n"), 16, 8, "keep")
    out = windows.clip_membership(placed.join(sizes, "user_id"), "pos", n_clips)
    return out.select("event_id", F.col("clip_index").cast("int"), (F.col("pos") - F.col("clip_index") * 8).alias("local"))


def features(v):
    rows = v["v_detections"].withColumn("t_idx", F.col("frame_index"))
    return tracks.temporal_deltas(tracks.box_features(rows, 400, 400))


FEATURES = """
(select video_id, frame_index as t_idx, track_id, cx, cy, w, h, area, case when adj then cx - pcx else 0 end as dcx, case when adj then cy - pcy else 0 end as dcy,
  case when adj then area - parea else 0 end as darea,
  sqrt(case when adj then (cx - pcx) * (cx - pcx) + (cy - pcy) * (cy - pcy) else 0 end) as velocity, x1, y1, x2, y2
from (select *, coalesce(lag(frame_index) over k = frame_index - 1, false) as adj, lag(cx) over k as pcx, lag(cy) over k as pcy, lag(area) over k as parea
      from (select *, (x1 + x2) / 2 / 400 as cx, (y1 + y2) / 2 / 400 as cy, (x2 - x1) / 400 as w, (y2 - y1) / 400 as h,
              (x2 - x1) / 400 * ((y2 - y1) / 400) as area from v_detections) a
      window k as (partition by video_id, track_id order by frame_index)) b)
"""


@query("temporal_deltas", f"""
select video_id, track_id, t_idx, round(dcx, 6) as dcx, round(dcy, 6) as dcy, round(darea, 6) as darea, round(velocity, 6) as velocity from {FEATURES} f
""")
def temporal_deltas(v):
    return features(v).select(
        "video_id", "track_id", "t_idx", *[F.round(c, 6).alias(c) for c in ("dcx", "dcy", "darea", "velocity")]
    )


_GEO = ["cx", "cy", "w", "h", "area", "dcx", "dcy", "darea", "velocity"]


@query("window_gather_lengths", f"""
with f as (select f.*, 5 + video_id % 12 as nf from {FEATURES} f where t_idx < 5 + video_id % 12)
select p.video_id, p.track_id, p.clip_index, cast(least(8, p.nf - p.clip_index * 4) as int) as n_rows, count(f.t_idx) as n_present, round(coalesce(sum(f.cx), 0), 5) as cx
from (select video_id, track_id, nf, cast(unnest(range(cast(ceil(greatest(1, nf - 7) / 4.0e0) as int))) as int) as clip_index from (select distinct video_id, track_id, nf from f) d) p
left join f on f.video_id = p.video_id and f.track_id = p.track_id and f.t_idx >= p.clip_index * 4 and f.t_idx < p.clip_index * 4 + 8
group by p.video_id, p.track_id, p.clip_index, p.nf
""")
def window_gather_lengths(v):
    """Videos of 5 to 16 frames, each with the windows of its own length."""
    long = features(v).withColumn("n_frames", 5 + F.col("video_id") % 12)
    packed = tracks.gather_windows(long, ["video_id", "track_id"], tracks.GEOMETRY, "n_frames", 8, 4)
    total = lambda i: F.aggregate("matrix", F.lit(0.0), lambda acc, row: acc + F.get(row, F.lit(i)))
    return packed.select(
        "video_id", "track_id", "clip_index", F.size("matrix").alias("n_rows"), total(7).cast("bigint").alias("n_present"), F.round(total(0), 5).alias("cx"))


@query("window_gather", f"""
select p.video_id, p.track_id, p.clip_index, count(f.t_idx) as n_present,
  coalesce(string_agg(cast(f.t_idx - p.clip_index * 4 as varchar), ',' order by f.t_idx), '') as present,
  {', '.join(f"round(coalesce(sum(f.{c}), 0), 5) as {c}" for c in _GEO)}
from (select video_id, track_id, cast(unnest(range(3)) as int) as clip_index from (select distinct video_id, track_id from v_detections) d) p
left join {FEATURES} f on f.video_id = p.video_id and f.track_id = p.track_id and f.t_idx >= p.clip_index * 4 and f.t_idx < p.clip_index * 4 + 8
group by p.video_id, p.track_id, p.clip_index
""")
def window_gather(v):
    packed = tracks.gather_windows(features(v), ["video_id", "track_id"], tracks.GEOMETRY, 16, 8, 4)
    at = {"cx": 0, "cy": 1, "w": 2, "h": 3, "area": 6, "dcx": 8, "dcy": 9, "darea": 10, "velocity": 11}

    def total(i):
        return F.aggregate("matrix", F.lit(0.0), lambda acc, row: acc + F.get(row, F.lit(i)))

    present = F.transform(F.col("matrix"), lambda row, i: F.when(F.get(row, F.lit(7)) > 0, i))
    return packed.select(
        "video_id", "track_id", "clip_index",
        total(7).cast("bigint").alias("n_present"),
        F.array_join(F.array_compact(present), ",").alias("present"),
        *[F.round(total(i), 5).alias(c) for c, i in at.items()],
    )


_PAIR_SQL = f"""
(select a.video_id, a.t_idx, a.track_id as track_i, b.track_id as track_j,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
  (a.x2 - a.x1) * (a.y2 - a.y1) as area_i, (b.x2 - b.x1) * (b.y2 - b.y1) as area_j, a.cx - b.cx as dx, a.cy - b.cy as dy
from {FEATURES} a join {FEATURES} b on a.video_id = b.video_id and a.t_idx = b.t_idx and a.track_id < b.track_id)
"""


@query("window_gather_pairs", f"""
select p.video_id, p.track_i, p.track_j, p.clip_index, round(coalesce(sum(inter / greatest(area_i + area_j - inter, 1e-6)), 0), 5) as iou,
  round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0), 5) as distance, round(coalesce(sum(dx), 0), 5) as dx, round(coalesce(sum(dy), 0), 5) as dy
from (select video_id, track_i, track_j, cast(unnest(range(3)) as int) as clip_index from (select distinct video_id, track_i, track_j from {_PAIR_SQL} d) e) p
left join {_PAIR_SQL} f on f.video_id = p.video_id and f.track_i = p.track_i and f.track_j = p.track_j and f.t_idx >= p.clip_index * 4 and f.t_idx < p.clip_index * 4 + 8
group by p.video_id, p.track_i, p.track_j, p.clip_index
""")
def window_gather_pairs(v):
    pairs = tracks.track_pairs(tracks.box_features(v["v_detections"].withColumn("t_idx", F.col("frame_index")), 400, 400))
    keys = ["video_id", "track_i", "track_j"]
    packed = tracks.gather_windows(pairs, keys, tracks.PAIR, 16, 8, 4)

    def total(i):
        cells = [F.coalesce(F.get(F.get("matrix", F.lit(k)), F.lit(i)), F.lit(0.0)) for k in range(8)]
        return F.round(reduce(lambda a, b: a + b, cells), 5)

    return packed.select(
        *keys, "clip_index", total(0).alias("iou"), total(1).alias("distance"), total(4).alias("dx"), total(5).alias("dy")
    )


@query("track_pairs", f"""
select video_id, t_idx, track_i, track_j, inter / greatest(area_i + area_j - inter, 1e-6) as iou, sqrt(dx * dx + dy * dy) as distance,
  inter / greatest(area_i, 1e-6) as cont_ij, inter / greatest(area_j, 1e-6) as cont_ji, dx, dy
from {_PAIR_SQL} p
""")
def track_pairs(v):
    pairs = tracks.track_pairs(tracks.box_features(v["v_detections"].withColumn("t_idx", F.col("frame_index")), 400, 400))
    return pairs.select("video_id", "t_idx", "track_i", "track_j", *tracks.PAIR)


@query("filtered_ranges", """
select video_id, min(clip_index) as first_pos, max(clip_index) as last_pos, count(*) as n_clips
from (select video_id, clip_index, clip_index - row_number() over (partition by video_id order by clip_index) as run
      from v_ann_clips where n_events = 0 and n_objects = 0) r group by video_id, run
""")
def filtered_ranges(v):
    static = (F.col("n_events") == 0) & (F.col("n_objects") == 0)
    return windows.filtered_ranges(v["v_ann_clips"], ["video_id"], "clip_index", static)


def clip_frames(v):
    """Gray frames as clips of 16; the number of frames is one scalar."""
    total = v["v_frames"].agg(F.count(F.lit(1))).scalar()
    framed = v["v_frames"].withColumn("total", total)
    at = F.floor(F.col("frame_pos") / 16)
    return framed.select(
        at.alias("clip_id"), (F.col("frame_pos") % 16).alias("local"),
        F.least(F.lit(16), F.col("total") - at * 16).alias("n"), "gray",
    )


_MOTION = """
(select clip_id, n, case when n < 2 then 0.0 else greatest(
    list_avg(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), list_avg(list_transform(list_zip(b, c), lambda z: abs(z[1] - z[2])))) end as score
from (select clip_id, n, max(gray) filter (where local = 0) as a, max(gray) filter (where local = n // 2) as b, max(gray) filter (where local = n - 1) as c
      from (select cast(frame_pos // 16 as bigint) as clip_id, frame_pos % 16 as local, gray, count(*) over (partition by frame_pos // 16) as n from v_frames) f
      group by clip_id, n) g)
"""


@query("motion_score", f"select clip_id, n as n_frames, round(score, 6) as motion_score from {_MOTION} m")
def motion_score(v):
    out = motion.motion_scores(clip_frames(v), ["clip_id"], "local", "n")
    return out.select("clip_id", "n_frames", F.round("motion_score", 6).alias("motion_score"))


def _stub(prompt: str) -> str:
    """Stands in for a model: answers with the prompt reversed, fails on clips ending in 7."""
    if prompt.endswith("7"):
        raise RuntimeError("no answer")
    return prompt[::-1]


@query("motion_filter", f"""
select clip_id, score >= 28.5 as inferred, case when score >= 28.5 and clip_id % 10 <> 7 then reverse(concat('clip ', clip_id)) end as raw,
  case when score >= 28.5 and clip_id % 10 = 7 then 'no answer' end as error from {_MOTION} m
""")
def motion_filter(v):
    scored = motion.motion_scores(clip_frames(v), ["clip_id"], "local", "n")
    prompts = scored.withColumn("user_prompt", F.concat(F.lit("clip "), F.col("clip_id").cast("string")))
    return motion.annotate_moving(prompts, ["clip_id"], 28.5, _stub).select("clip_id", "inferred", "raw", "error")


class _StubClient:
    """A model that turns prompts round; every tenth clip has no answer."""

    def __call__(self, request: dict) -> str:
        if request["clip_index"] % 10 == 7:
            raise RuntimeError("no answer")
        return f"{request['user_prompt'][::-1]} of {len(request['frames'])}"


@query("annotate_batches", """
select video_id, clip_index, case when clip_index % 10 <> 7 then concat(reverse(concat('clip ', clip_index)), ' of 2') end as raw,
  case when clip_index % 10 = 7 then 'no answer' end as error from v_ann_clips where n_events + n_objects > 0
""")
def annotate_batches(v):
    moving = v["v_ann_clips"].where("n_events + n_objects > 0")
    prompts = moving.withColumns({
        "user_prompt": F.concat(F.lit("clip "), F.col("clip_index").cast("string")),
        "frames": F.array(*[F.encode(F.concat(F.lit(f"{k}:"), F.col("clip_index").cast("string")), "utf-8") for k in range(2)])})
    return motion.annotate_batches(prompts, ["video_id", "clip_index"], _StubClient, ["clip_index", "user_prompt", "frames"], most=4)


@query("annotate_clips", """
select video_id, clip_index, case when clip_index % 10 <> 7 then reverse(concat('clip ', clip_index)) end as raw,
  case when clip_index % 10 = 7 then 'no answer' end as error from v_ann_clips where n_events + n_objects > 0
""")
def annotate_clips(v):
    moving = v["v_ann_clips"].where("n_events + n_objects > 0")
    prompts = moving.withColumn("user_prompt", F.concat(F.lit("clip "), F.col("clip_index").cast("string")))
    return motion.annotate_clips(prompts, ["video_id", "clip_index"], _stub)
