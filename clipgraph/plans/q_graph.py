"""Graph queries and attention analytics (Q and H rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.operators import attention, graph, nms
from clipgraph.plans.q_match import EVENT_KEY, NMS_SQL
from clipgraph.plans.registry import query

_TIMELINE = """
(select distinct event_seq, video_id, frame, action, track_id from (
  select event_seq, video_id, frame, action, unnest([agent_track_id, target_track_id, source_track_id, destination_track_id]) as track_id from v_edges) u where track_id is not null)
"""


@query("object_timeline", f"select event_seq, video_id, track_id, frame from {_TIMELINE} t")
def object_timeline(v):
    return graph.object_timeline(v["v_edges"]).select("event_seq", "video_id", "track_id", "frame")


@query("object_timeline_of", """
select event_seq, video_id, frame, action from v_edges
where agent_track_id = 3 or target_track_id = 3 or coalesce(source_track_id, -1) = 3 or coalesce(destination_track_id, -1) = 3
""")
def object_timeline_of(v):
    return graph.object_timeline(v["v_edges"], 3).select("event_seq", "video_id", "frame", "action")


@query("events_in_range", "select event_seq, video_id, frame, action from v_edges where frame between 20 and 60")
def events_in_range(v):
    return graph.events_in_range(v["v_edges"], 20, 60).select("event_seq", "video_id", "frame", "action")


@query("object_history", f"""
select t.event_seq, t.video_id, t.track_id, t.frame from {_TIMELINE} t join v_nodes n on n.video_id = t.video_id and n.track_id = t.track_id
where n.category = 'cat1' and t.frame between 10 and 90
""")
def object_history(v):
    out = graph.object_history(v["v_edges"], v["v_nodes"], "cat1", (10, 90))
    return out.select("event_seq", "video_id", "track_id", "frame")


@query("current_location", """
select video_id, target_track_id as track_id, arg_max(coalesce(destination_track_id, -1), cast(frame as bigint) * 100000000 + event_seq) as location, max(frame) as since_frame
from v_edges where action in ('click', 'purchase') and frame <= 80 group by 1, 2
""")
def current_location(v):
    out = graph.current_location(v["v_edges"], 80, ["click", "purchase"])
    return out.withColumn("location", F.coalesce("location", F.lit(-1)))


@query("events_by_action", """
select e.event_seq, e.video_id, e.frame from v_edges e join v_nodes n on n.video_id = e.video_id and n.track_id = e.agent_track_id
where e.action = 'view' and e.frame between 10 and 100 and n.category = 'cat2'
""")
def events_by_action(v):
    out = graph.events_by_action(v["v_edges"], v["v_nodes"], "view", (10, 100), "cat2")
    return out.select("event_seq", "video_id", "frame")


@query("location_contents", """
select video_id, location, track_id from (
  select video_id, case when action = 'click' then destination_track_id else source_track_id end as location, target_track_id as track_id,
    arg_max(action = 'click', cast(frame as bigint) * 100000000 + event_seq) as inside
  from v_edges where action in ('click', 'view') and frame <= 100 group by 1, 2, 3) x where inside and location is not null
""")
def location_contents(v):
    return graph.location_contents(v["v_edges"], 100, "click", "view").select("video_id", "location", "track_id")


@query("search_events", """
select e.event_seq, e.video_id, e.frame from v_edges e join v_nodes a on a.video_id = e.video_id and a.track_id = e.agent_track_id
join v_nodes t on t.video_id = e.video_id and t.track_id = e.target_track_id
where e.action = 'signup' and a.category = 'cat1' and t.category = 'cat2' and e.frame between 5 and 110 and e.confidence >= 0.3
""")
def search_events(v):
    out = graph.search_events(
        v["v_edges"], v["v_nodes"], action="signup", agent_category="cat1", target_category="cat2", frames=(5, 110), min_confidence=0.3
    )
    return out.select("event_seq", "video_id", "frame")


FLAGSHIP_SQL = f"""
with recursive {NMS_SQL.format(floor='0.5e0')},
t as (select distinct event_seq, video_id, frame, confidence, track_id from (
  select event_seq, video_id, frame, confidence, unnest([agent_track_id, target_track_id, source_track_id, destination_track_id]) as track_id from n where keep) u where track_id is not null)
select video_id, track_id, count(*) as n_events, min(frame) as first_frame, max(frame) as last_frame, round(max(confidence), 6) as confidence from t group by 1, 2
"""


@query("object_activity", FLAGSHIP_SQL)
def object_activity(v):
    """Flagship: confident events, duplicates suppressed, numbered, and summed up per object."""
    kept = nms.suppress_duplicates(v["v_edges"].where("confidence >= 0.5"), EVENT_KEY)
    timeline = graph.object_timeline(kept)
    return timeline.groupBy("video_id", "track_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.round(F.max("confidence"), 6).alias("confidence"),
    )


@query("spatial_map", "select sample_id, slot, y, x, round(sum(w), 6) as w from v_attn group by all")
def spatial_map(v):
    return attention.spatial_map(v["v_attn"]).withColumn("w", F.round("w", 6))


@query("slot_ownership", """
select sample_id, y, x, cast(arg_max(slot, n * 1000 - slot) as int) as owner from (
  select sample_id, y, x, slot, count(*) as n from (
    select sample_id, t, y, x, slot, row_number() over (partition by sample_id, t, y, x order by w desc, slot) as rn from v_attn) a where rn = 1 group by all) b group by all
""")
def slot_ownership(v):
    return attention.slot_ownership(v["v_attn"])[1]


@query("temporal_profile", """
select slot, t, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std from (select sample_id, slot, t, sum(w) as m from v_attn group by all) a group by all
""")
def temporal_profile(v):
    return attention.temporal_profile(v["v_attn"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_ENTROPY = """
(select sample_id, slot, -sum(p * ln(p + 1e-10)) as entropy from (
  select sample_id, slot, w / (sum(w) over (partition by sample_id, slot) + 1e-10) as p from (select sample_id, slot, y, x, sum(w) as w from v_attn group by all) a) b group by all)
"""


@query("spatial_entropy", f"""
select slot, round(avg(entropy), 6) as mean, round(stddev_samp(entropy), 6) as std, round(ln(4.0e0), 6) as max_entropy from {_ENTROPY} e group by slot
""")
def spatial_entropy(v):
    return attention.slot_entropy(v["v_attn"], 4).withColumns({c: F.round(c, 6) for c in ("mean", "std", "max_entropy")})


@query("token_entropy", "select sample_id, t, y, x, round(-sum(w * ln(w + 1e-10)), 6) as entropy from v_attn group by all")
def token_entropy(v):
    return attention.token_entropy(v["v_attn"]).withColumn("entropy", F.round("entropy", 6))


_ACTIVE = "(select sample_id, count(*) filter (where existence > 0.5) as n_active from v_slots group by 1)"


@query("active_slots", f"""
select count(*) as n_samples, round(avg(n_active), 6) as mean, min(n_active) as min, max(n_active) as max from {_ACTIVE} a
""")
def active_slots(v):
    return attention.active_summary(v["v_slots"]).withColumn("mean", F.round("mean", 6))


@query("active_categories", """
select cast(list_position(cat_logits, list_max(cat_logits)) - 1 as int) as category_id, count(*) as n from v_slots where existence > 0.5 group by 1
""")
def active_categories(v):
    return attention.active_categories(v["v_slots"])


_UNIT = """
(select sample_id, slot, y, x, w / greatest(sqrt(sum(w * w) over (partition by sample_id, slot)), 1e-12) as w
 from (select sample_id, slot, y, x, sum(w) as w from v_attn group by all) a)
"""


@query("slot_consistency", f"""
with u as {_UNIT}
select a.slot, (select count(distinct sample_id) from u) as n_samples, round(sum(a.w * b.w) / greatest((select count(distinct sample_id) * (count(distinct sample_id) - 1) / 2 from u), 1), 6) as consistency
from u a join u b on a.slot = b.slot and a.y = b.y and a.x = b.x and a.sample_id < b.sample_id group by a.slot
""")
def slot_consistency(v):
    return attention.slot_consistency(v["v_attn"]).withColumn("consistency", F.round("consistency", 6))


@query("slot_similarity", f"""
with m as (select slot, y, x, avg(w) as w from {_UNIT} u group by all)
select a.slot as slot_a, b.slot as slot_b, round(sum(a.w * b.w), 6) as similarity from m a join m b on a.y = b.y and a.x = b.x group by all
""")
def slot_similarity(v):
    return attention.slot_similarity(v["v_attn"]).withColumn("similarity", F.round("similarity", 6))
