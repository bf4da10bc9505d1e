"""Streaming forms (T rows) and SQL functions (U4) of the survey."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import sql as sql_functions
from clipgraph.plans.registry import query
from clipgraph.streaming import jobs


@query("stream_clip_windows", """
select user_id, strftime(s, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (
  select user_id, ts, unnest([time_bucket(interval '8 hours', ts), time_bucket(interval '8 hours', ts) - interval '8 hours']) as s from events) w
where s + interval '16 hours' <= (select max(ts) - interval '1 hour' from events) group by 1, 2
""")
def stream_clip_windows(v):
    """Windows of 16 hours every 8 hours over the event stream (the clip window at one frame per hour)."""
    stream = jobs.event_stream(v.spark, v.sf_dir)
    out = jobs.run_available(
        jobs.clip_window_counts(stream, "ts", ["user_id"], "16 hours", "8 hours", "1 hour"), v.spark, "windows"
    )
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stream_static_ranges", """
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts, count(*) as n
from (select user_id, ts, sum(b) over (partition by user_id order by ts) as run from (
    select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '24 hours' then 0 else 1 end as b from events where event_type = 'error') a) c
group by user_id, run having max(ts) + interval '24 hours' <= (select max(ts) - interval '1 hour' from events where event_type = 'error')
""")
def stream_static_ranges(v):
    stream = jobs.event_stream(v.spark, v.sf_dir).where("event_type = 'error'")
    out = jobs.run_available(jobs.static_ranges(stream, "ts", ["user_id"], "24 hours", "1 hour"), v.spark, "ranges")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", text("first_ts"), text("last_ts"), "n")


# As the batch form, but an event waits while a better one may still come or waits itself: of frames before the watermark all is there.
@query("stream_nms", """
with recursive h as (select floor((epoch(max(ts)) - 3600 - 1704067200) / 21600) as horizon from events),
e as (select *, cast((extract(day from ts) - 1) * 4 + floor(extract(hour from ts) / 6) as int) as fr,
    row_number() over (partition by video_id, action, agent_track_id, target_track_id order by confidence desc, event_seq) as rn
  from (select event_id as event_seq, concat('v', user_id % 5) as video_id, event_type as action, cast(user_id % 30 as int) as agent_track_id,
    cast(regexp_extract(props, '[0-9]+', 0) as int) % 10 as target_track_id, ts, value / (value + 50e0) as confidence from events) x),
n as (select e.*, cast([] as int[]) as kept, cast([] as int[]) as waiting, -1 as state, cast(0 as bigint) as place from e where rn = 1
  union all
  select o.*, case when d = 1 then list_append(n.kept, o.fr) else n.kept end, case when d = -1 then list_append(n.waiting, o.fr) else n.waiting end, d, n.place + 1
  from n join e o on o.video_id = n.video_id and o.action = n.action and o.agent_track_id = n.agent_track_id
    and o.target_track_id = n.target_track_id and o.rn = n.place + 1,
  lateral (select case when len(list_filter(n.kept, lambda k: abs(k - o.fr) <= 3)) > 0 then 0
    when o.fr + 3 < (select horizon from h) and len(list_filter(n.waiting, lambda k: abs(k - o.fr) <= 3)) = 0 then 1 else -1 end as d) s)
select video_id, action, agent_track_id, target_track_id, event_seq, fr as frame, round(confidence, 6) as confidence from n where place > 0 and state = 1
""")
def stream_nms(v):
    """Suppression over the event stream; frames are the 6-hour steps of January 2024."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    frame = (F.dayofmonth("ts") - 1) * 4 + F.floor(F.hour("ts") / 6).cast("int")
    stream = jobs.event_stream(v.spark, v.sf_dir).select(
        F.concat(F.lit("v"), (F.col("user_id") % 5).cast("string")).alias("video_id"), F.col("event_type").alias("action"),
        (F.col("user_id") % 30).cast("int").alias("agent_track_id"), (k % 10).alias("target_track_id"), "ts",
        frame.alias("frame"), (F.col("value") / (F.col("value") + 50.0)).alias("confidence"), F.col("event_id").alias("event_seq"),
    )
    keys = ["video_id", "action", "agent_track_id", "target_track_id"]
    jan = 1704067200.0  # epoch second of 2024-01-01
    out = jobs.run_available(jobs.suppress_duplicates(stream, keys, "ts", (jan, 21600.0), "1 hour"), v.spark, "nms")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("sql_functions", """
select a.video_id, a.frame_index, a.track_id as track_i, b.track_id as track_j,
  case when u <= 0 then 0 else inter / u end as iou, inter / greatest(area_i, 1e-6) as containment
from (select a.*, b.track_id as other, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) as area_i,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as u
  from v_detections a join v_detections b on a.video_id = b.video_id and a.frame_index = b.frame_index and a.track_id < b.track_id) a
join (select distinct track_id from v_detections) b on b.track_id = a.other
""")
def sql_functions_query(v):
    sql_functions.register(v.spark)
    return v.spark.sql(
        """
        select a.video_id, a.frame_index, a.track_id as track_i, b.track_id as track_j,
          box_iou(array(a.x1, a.y1, a.x2, a.y2), array(b.x1, b.y1, b.x2, b.y2)) as iou,
          box_containment(array(a.x1, a.y1, a.x2, a.y2), array(b.x1, b.y1, b.x2, b.y2)) as containment
        from {d} a join {d} b on a.video_id = b.video_id and a.frame_index = b.frame_index and a.track_id < b.track_id
        """,
        d=v["v_detections"],
    )


@query("sql_prf", """
select video_id, round(case when p > 0 then least(g, p) / p else 0 end, 6) as precision, round(case when g > 0 then least(g, p) / g else 0 end, 6) as recall,
  round(case when g + p > 0 then 2.0e0 * least(g, p) / (g + p) else 0 end, 6) as f1
from (select video_id, count(*) filter (where side = 'gt') as g, count(*) filter (where side = 'pred') as p from v_gt group by 1) c
""")
def sql_prf(v):
    sql_functions.register(v.spark)
    return v.spark.sql(
        """
        select video_id, round(r.precision, 6) as precision, round(r.recall, 6) as recall, round(r.f1, 6) as f1
        from (select video_id, prf(least(g, p), p - least(g, p), g - least(g, p)) as r
              from (select video_id, count_if(side = 'gt') as g, count_if(side = 'pred') as p from {e} group by video_id) c) d
        """,
        e=v["v_gt"],
    )
