"""Joins and matching (J rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import arrays
from clipgraph.operators import decode, encode, match, nms, tracks, windows
from clipgraph.operators.assignment import assign_groups
from clipgraph.plans.pairing_sql import pairing
from clipgraph.plans.q_scalar import ACTION_RULES, action_rules
from clipgraph.plans.q_windows import FEATURES
from clipgraph.plans.registry import query
from clipgraph.session import settle
from clipgraph.sources import inventory
from clipgraph.vocab import vocab_from_table


@query("clip_feature_join", """
select video_id, clip_index from v_ann_clips c where (n_events > 0 or n_objects > 0)
  and exists (select 1 from v_feature_clips f where f.video_id = c.video_id and f.clip_index = c.clip_index)
""")
def clip_feature_join(v):
    return encode.clips_with_features(v["v_ann_clips"], v["v_feature_clips"], ["video_id", "clip_index"]).select(
        "video_id", "clip_index"
    )


@query("inventory_intersect", """
select o_orderkey as id, o_custkey in (select c_custkey from customer where c_acctbal > 0) as compact_available
from orders where o_orderkey in (select l_orderkey from lineitem)
""")
def inventory_intersect(v):
    annotated = v["orders"].select(F.col("o_orderkey").alias("id"), "o_custkey")
    features_ = v["lineitem"].select(F.col("l_orderkey").alias("id"))
    compacted = v["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return inventory.intersect_inventory(annotated, features_, compacted, "id", "o_custkey").select("id", "compact_available")


@query("vocab_join", """
select p_partkey, coalesce(c.id, 5) as category_id from part left join
  (select p_type, cast(row_number() over (order by p_type) - 1 as int) as id from (select distinct p_type from part where p_type <> 'PROMO') d) c on c.p_type = part.p_type
""")
def vocab_join(v):
    known = vocab_from_table(v["part"].where("p_type <> 'PROMO'"), "p_type", "p_type", "category_id")
    return encode.lookup_category(v["part"], known, "p_type", unknown_id=5).select("p_partkey", "category_id")


_INDEX = "(select clip_id, obj_id, row_number() over (partition by clip_id order by obj_id) - 1 as idx from v_ann_objects)"


@query("role_joins", f"""
select e.event_seq, a.idx as agent_idx, t.idx as target_idx, s.idx as source_idx, d.idx as dest_idx from v_ann_events e
join {_INDEX} a on a.clip_id = e.clip_id and a.obj_id = e.agent join {_INDEX} t on t.clip_id = e.clip_id and t.obj_id = e.target
left join {_INDEX} s on s.clip_id = e.clip_id and s.obj_id = e.source left join {_INDEX} d on d.clip_id = e.clip_id and d.obj_id = e.destination
""")
def role_joins(v):
    placed = encode.object_index(v["v_ann_objects"], "clip_id", ["obj_id"])
    return encode.join_roles(v["v_ann_events"], placed, "clip_id").select(
        "event_seq", "agent_idx", "target_idx", "source_idx", "dest_idx"
    )


@query("encode_events", f"""
select e.event_seq, cast(r.action_id as int) as action_class, a.idx as agent_track_id, t.idx as target_track_id, s.idx as source_track_id, d.idx as dest_track_id,
  greatest(0, least(e.frame, 15)) as event_frame_index from v_ann_events e join {ACTION_RULES} r on r.action = e.action
join {_INDEX} a on a.clip_id = e.clip_id and a.obj_id = e.agent join {_INDEX} t on t.clip_id = e.clip_id and t.obj_id = e.target
left join {_INDEX} s on s.clip_id = e.clip_id and s.obj_id = e.source left join {_INDEX} d on d.clip_id = e.clip_id and d.obj_id = e.destination
""")
def encode_events(v):
    placed = encode.object_index(v["v_ann_objects"], "clip_id", ["obj_id"])
    out = encode.encode_events(v["v_ann_events"], placed, action_rules(v), "clip_id")
    return out.select("event_seq", *encode.ENCODED)


@query("enrich_by_position", """
select video_id, clip_index, case when n_events = 0 and n_objects = 0 then 'motion_filtered' else 'annotated' end as status,
  case when clip_index < n_stamps then array_to_string(list_transform(range(16), lambda j: cast((clip_index * 8 + j) * 20 as int)), ',') else '' end as frame_indices,
  case when clip_index < n_stamps then strftime(timestamp '2026-01-01 12:00:00' + to_seconds(clip_index * 8), '%Y-%m-%dT%H:%M:%S') else '' end as start_time,
  case when clip_index < n_stamps then clip_index * 8.0e0 + 15 else 0.0 end as end_offset_sec
from (select *, 20 + video_id % 15 as n_stamps from v_ann_clips) c
""")
def enrich_by_position(v):
    """Every user as a 20-fps video whose length gives 20 to 34 full windows."""
    users = v["v_ann_clips"].select("video_id").distinct()
    videos = users.select(
        F.concat(F.lit("20260101_120000_"), F.col("video_id").cast("string")).alias("video_id"),
        F.lit(20.0).alias("source_fps"),
        (((F.lit(20) + F.col("video_id") % 15 - 1) * 8 + 16) * 20).cast("int").alias("total_frames"),
        F.col("video_id").alias("user"),
    )
    stamps = windows.clip_timestamps(windows.with_frame_indices(windows.clip_windows(windows.with_start_time(videos))))
    stamps = stamps.drop("video_id").withColumnRenamed("user", "video_id")
    out = windows.enrich_by_position(v["v_ann_clips"], stamps, ["video_id"], "clip_index")
    return out.select(
        "video_id", "clip_index", "status", arrays.csv(F.col("frame_indices")).alias("frame_indices"), "start_time", "end_offset_sec"
    )


SEPARATION = """
(select a.video_id, a.frame_index, a.track_id, a.category, case when count(b.track_id) = 0 then 1.0e0
  else (1 - max(case when b.track_id is null then 0 when u <= 0 then 0 else inter / u end)) * greatest(a.score, 0.1) end as match_score
from (select a.*, b.track_id as other from v_detections a left join v_detections b on a.video_id = b.video_id and a.frame_index = b.frame_index and a.category = b.category and a.track_id <> b.track_id) a
left join lateral (select b.track_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as u
  from v_detections b where b.video_id = a.video_id and b.frame_index = a.frame_index and b.track_id = a.other) b on true
group by a.video_id, a.frame_index, a.track_id, a.category, a.score)
"""


@query("separation_score", f"select video_id, frame_index, track_id, match_score from {SEPARATION} s")
def separation_score(v):
    return tracks.separation_scores(v["v_detections"]).select(
        "video_id", "frame_index", "track_id", "match_score"
    )


@query("candidate_pairs", f"""
select o.video_id, o.obj_id, s.track_id, s.match_score from v_vlm_objects o
join {SEPARATION} s on s.video_id = o.video_id and s.frame_index = o.first_seen_frame and lower(s.category) = lower(o.category)
""")
def candidate_pairs(v):
    return match.candidate_pairs(v["v_vlm_objects"], v["v_detections"]).select(
        "video_id", "obj_id", "track_id", "match_score"
    )


ALIGN_SQL = f"""
with recursive sep as materialized (select * from {SEPARATION} s),
obj as materialized (select video_id, lower(category) as cat, obj_id, first_seen_frame,
  row_number() over (partition by video_id, lower(category) order by first_seen_frame, obj_id) as i from v_vlm_objects),
trk as materialized (select video_id, cat, track_id, row_number() over (partition by video_id, cat order by track_id) - 1 as j, null as prev
  from (select distinct video_id, lower(category) as cat, track_id from v_detections) t),
prs as materialized (select o.video_id, o.cat, o.i, t.j, cast(round((1 - s.match_score) * 1e9) as bigint) as ic, s.match_score as sc
  from obj o join sep s on s.video_id = o.video_id and s.frame_index = o.first_seen_frame and lower(s.category) = o.cat
  join trk t on t.video_id = o.video_id and t.cat = o.cat and t.track_id = s.track_id),
{pairing("pr", "obj", "trk", "prs", "video_id, cat", partial=1_000_000_000)},
kept as (select video_id, obj_id, track_id, 1 - (1 - sc) as score from pr join obj using (video_id, cat, i) join trk using (video_id, cat, j)
  join prs using (video_id, cat, i, j) where 1 - (1 - sc) >= 0.3)
"""


def aligned(v):
    """The objects, which the alignment reads several times, and their tracks."""
    objects = settle(v["v_vlm_objects"])
    return objects, match.align(objects, v["v_detections"])


@query("align", ALIGN_SQL + "select video_id, obj_id, track_id, round(score, 8) as score from kept")
def align(v):
    return aligned(v)[1].withColumn("score", F.round("score", 8))


@query("alignment_confidence", ALIGN_SQL + """
select coalesce(o.video_id, t.video_id) as video_id, coalesce(k.n, 0) as n_matched, coalesce(o.n, 0) - coalesce(k.n, 0) as unmatched_objects,
  coalesce(t.n, 0) - coalesce(k.n, 0) as unmatched_tracks, round(case when coalesce(o.n, 0) = 0 then 1.0 else coalesce(k.c, 0.0) end, 6) as confidence
from (select video_id, count(*) as n from v_vlm_objects group by 1) o full join (select video_id, count(distinct track_id) as n from v_detections group by 1) t on o.video_id = t.video_id
left join (select video_id, count(*) as n, avg(score) as c from kept group by 1) k on k.video_id = coalesce(o.video_id, t.video_id)
""")
def alignment_confidence(v):
    objects, mapping = aligned(v)
    out = match.alignment_summary(objects, v["v_detections"], mapping)
    return out.withColumn("confidence", F.round("confidence", 6))


def sides(v):
    return v["v_gt"].where("side = 'gt'"), v["v_gt"].where("side = 'pred'")


@query("match_objects", """
select a.video_id, a.clip_index, a.target_category, a.event_seq as gt_id, b.event_seq as pred_id
from (select *, row_number() over (partition by video_id, clip_index, target_category order by event_seq) as k from v_gt where side = 'gt') a
join (select *, row_number() over (partition by video_id, clip_index, target_category order by event_seq) as k from v_gt where side = 'pred') b
  on a.video_id = b.video_id and a.clip_index = b.clip_index and a.target_category = b.target_category and a.k = b.k
""")
def match_objects(v):
    truth, pred = sides(v)
    return match.match_objects(truth, pred, ["video_id", "clip_index"], "target_category", "event_seq")


@query("event_cost", """
select a.video_id, a.clip_index, a.action as gt_action, a.frame as gt_frame, b.action as pred_action, b.frame as pred_frame,
  a.target_category as gt_target, b.target_category as pred_target, a.n as n_gt, b.n as n_pred,
  round((case when a.action = b.action then 0 else 1 end) + least(abs(a.frame - b.frame) / 16.0e0, 1) + (case when a.agent_category = b.agent_category then 0 else 0.5e0 end)
    + (case when a.target_category = b.target_category then 0 else 0.5e0 end), 6) as cost
from (select video_id, clip_index, action, frame, agent_category, target_category, count(*) as n from v_gt where side = 'gt' group by all) a
join (select video_id, clip_index, action, frame, agent_category, target_category, count(*) as n from v_gt where side = 'pred' group by all) b
  on a.video_id = b.video_id and a.clip_index = b.clip_index
""")
def event_cost(v):
    costs = match.event_costs(*sides(v), ["video_id", "clip_index"])
    return costs.select(
        "video_id", "clip_index",
        F.col("gt.action").alias("gt_action"), F.col("gt.frame").alias("gt_frame"),
        F.col("pred.action").alias("pred_action"), F.col("pred.frame").alias("pred_frame"),
        F.col("gt.target_category").alias("gt_target"), F.col("pred.target_category").alias("pred_target"),
        "n_gt", "n_pred", F.round("cost", 6).alias("cost"),
    )


# Optimum by dynamic programming over sets of used predictions; a skipped truth costs 1000.
@query("assignment", """
with recursive g as (select *, row_number() over (partition by video_id, clip_index order by event_seq) as i, count(*) over (partition by video_id, clip_index) as n from v_gt where side = 'gt'),
p as (select *, row_number() over (partition by video_id, clip_index order by event_seq) - 1 as j, count(*) over (partition by video_id, clip_index) as m from v_gt where side = 'pred'),
c as (select g.video_id, g.clip_index, g.i, g.n, p.j, p.m, (case when g.action = p.action then 0 else 1 end) + least(abs(g.frame - p.frame) / 16.0e0, 1)
        + (case when g.agent_category = p.agent_category then 0 else 0.5e0 end) + (case when g.target_category = p.target_category then 0 else 0.5e0 end) as cost
      from g join p on p.video_id = g.video_id and p.clip_index = g.clip_index),
opt as (select video_id, clip_index, i, n, m, cast(1 as bigint) << j as bit, cost from c
        union all select distinct video_id, clip_index, i, n, m, cast(0 as bigint), 1000e0 from c where n > m),
dp as (select video_id, clip_index, cast(1 as bigint) as i, n, m, bit as mask, cost from opt where i = 1
       union all select d.video_id, d.clip_index, d.i + 1, d.n, d.m, d.mask | o.bit, min(d.cost + o.cost)
       from dp d join opt o on o.video_id = d.video_id and o.clip_index = d.clip_index and o.i = d.i + 1 and (o.bit & d.mask) = 0
       group by 1, 2, 3, 4, 5, 6)
select video_id, clip_index, least(any_value(n), any_value(m)) as n_pairs, round(min(cost) - 1000 * greatest(any_value(n) - any_value(m), 0), 6) as total_cost
from dp where i = n group by video_id, clip_index
""")
def assignment(v):
    """Size and total cost of the optimal truth-to-prediction assignment of each clip."""
    clip = ["video_id", "clip_index"]
    costs = match.event_costs(*sides(v), clip).withColumns({"a": F.to_json("gt"), "b": F.to_json("pred")})
    solved = assign_groups(costs, clip, "a", "b", "cost", "n_gt", "n_pred")
    return solved.groupBy(*clip).agg(
        F.sum("n").alias("n_pairs"), F.round(F.sum(F.col("n") * F.col("cost")), 6).alias("total_cost")
    )


@query("assign_groups", f"""
with recursive f as materialized (select video_id, track_id, t_idx, cx, cy, track_id % 7 % 3 as kind from {FEATURES} f),
a as materialized (select video_id, kind, avg(cx) as px, avg(cy) as py, row_number() over (partition by video_id, kind order by track_id) as i from f where t_idx < 8 group by video_id, kind, track_id),
b as materialized (select video_id, kind, avg(cx) as qx, avg(cy) as qy, row_number() over (partition by video_id, kind order by track_id) - 1 as j, null as prev from f where t_idx >= 8 group by video_id, kind, track_id),
a2 as materialized (select * from a semi join b using (video_id, kind)),
c as materialized (select video_id, kind, i, j, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) as cost, cast(round(cost * 1e9) as bigint) as ic from a join b using (video_id, kind)),
{pairing("pr", "a2", "b", "c", "video_id, kind")}
select video_id, cast(kind as int) as kind, count(*) as n_pairs, round(sum(cost), 6) as total_cost from pr join c using (video_id, kind, i, j) group by all
""")
def assign_groups_query(v):
    """Least total centre distance between the tracks of one kind in each video's first and second half."""
    placed = tracks.box_features(v["v_detections"].withColumn("t_idx", F.col("frame_index")), 400, 400)
    placed = placed.withColumn("kind", F.col("track_id") % 7 % 3)
    early = placed.where("t_idx < 8").groupBy("video_id", "kind", "track_id").agg(F.avg("cx").alias("ax"), F.avg("cy").alias("ay"))
    late = placed.where("t_idx >= 8").groupBy("video_id", "kind", F.col("track_id").alias("late_id")).agg(
        F.avg("cx").alias("bx"), F.avg("cy").alias("by")
    )
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    costs = early.join(late, ["video_id", "kind"]).withColumn("cost", F.sqrt(dx * dx + dy * dy))
    solved = assign_groups(costs, ["video_id", "kind"], "track_id", "late_id")
    return solved.groupBy("video_id", "kind").agg(F.sum("n").alias("n_pairs"), F.round(F.sum("cost"), 6).alias("total_cost"))


EVENTS_SQL = f"""
with recursive gt as materialized (select *, row_number() over (partition by video_id, clip_index order by action, frame, agent_category, target_category, event_seq) as i
  from v_gt where side = 'gt'),
pd as materialized (select *, case when j > 0 and lag((action, frame, agent_category, target_category)) over (partition by video_id, clip_index order by j) = (action, frame, agent_category, target_category)
    then j - 1 end as prev
  from (select *, row_number() over (partition by video_id, clip_index order by action, frame, agent_category, target_category, event_seq) - 1 as j from v_gt where side = 'pred') p),
pc as materialized (select gt.video_id, gt.clip_index, gt.i, pd.j, (case when gt.action = pd.action then 0 else 1 end) + least(abs(gt.frame - pd.frame) / 16.0e0, 1)
    + (case when gt.agent_category = pd.agent_category then 0 else 0.5e0 end) + (case when gt.target_category = pd.target_category then 0 else 0.5e0 end) as cost,
    cast(round(cost * 1e9) as bigint) as ic from gt join pd using (video_id, clip_index)),
g2 as materialized (select * from gt semi join pd using (video_id, clip_index)),
{pairing("pr", "g2", "pd", "pc", "video_id, clip_index")},
mt as materialized (select pr.video_id, pr.clip_index, gt.event_seq as gt_id, pd.event_seq as pred_id, cost, gt.action as gt_action, pd.action as pred_action,
    gt.agent_category = pd.agent_category as same_agent, gt.target_category = pd.target_category as same_target
  from pr join pc using (video_id, clip_index, i, j) join gt using (video_id, clip_index, i) join pd using (video_id, clip_index, j) where cost < 2)
"""


@query("match_events", EVENTS_SQL + "select video_id, clip_index, gt_id, pred_id, round(cost, 6) as cost from mt")
def match_events(v):
    out = match.match_events(*sides(v), ["video_id", "clip_index"], "event_seq")
    return out.withColumn("cost", F.round("cost", 6))


@query("gt_clip_join", """
select g.video_id, g.clip_index, p.video_id is not null as has_prediction, case when f.video_id is null then 16 else 4 end as n_frames
from (select distinct video_id, clip_index from v_gt where side = 'gt') g
left join (select distinct video_id, clip_index from v_gt where side = 'pred') p on p.video_id = g.video_id and p.clip_index = g.clip_index
left join (select video_id, clip_index from v_feature_clips) f on f.video_id = g.video_id and f.clip_index = g.clip_index
""")
def gt_clip_join(v):
    truth, pred = sides(v)
    clips = truth.select("video_id", "clip_index").distinct()
    frames = v["v_feature_clips"].withColumn("frame_indices", F.sequence(F.lit(0), F.lit(3)))
    out = match.clip_join(clips, pred, ["video_id", "clip_index"], frames)
    return out.select("video_id", "clip_index", "has_prediction", F.size("frame_indices").alias("n_frames"))


NMS_SQL = """
e as (select *, row_number() over (partition by video_id, action, agent_track_id, target_track_id order by confidence desc, event_seq) rn from v_edges where confidence >= {floor}),
n as (select e.*, [frame] as kept, true as keep from e where rn = 1
  union all select e.*, case when len(list_filter(n.kept, lambda k: abs(k - e.frame) <= 3)) > 0 then n.kept else list_append(n.kept, e.frame) end,
                   len(list_filter(n.kept, lambda k: abs(k - e.frame) <= 3)) = 0
  from n join e on e.video_id = n.video_id and e.action = n.action and e.agent_track_id = n.agent_track_id and e.target_track_id = n.target_track_id and e.rn = n.rn + 1)
"""

EVENT_KEY = ["video_id", "action", "agent_track_id", "target_track_id"]


@query("nms_dedup", f"with recursive {NMS_SQL.format(floor='0e0')} select event_seq, video_id, frame, round(confidence, 6) as confidence from n where keep")
def nms_dedup(v):
    kept = nms.suppress_duplicates(v["v_edges"], EVENT_KEY)
    return kept.select("event_seq", "video_id", "frame", F.round("confidence", 6).alias("confidence"))


@query("slot_remap", """
select e.gt_id, a.slot as agent_track_id, t.slot as target_track_id, s.slot as source_track_id, d.slot as dest_track_id
from v_truth e join (select sample_id, obj_idx, (obj_idx + 3) % 24 as slot from v_truth_objects) a on a.sample_id = e.sample_id and a.obj_idx = e.agent_track_id
join (select sample_id, obj_idx, (obj_idx + 3) % 24 as slot from v_truth_objects) t on t.sample_id = e.sample_id and t.obj_idx = e.target_track_id
left join (select sample_id, obj_idx, (obj_idx + 3) % 24 as slot from v_truth_objects) s on s.sample_id = e.sample_id and s.obj_idx = e.source_track_id
left join (select sample_id, obj_idx, (obj_idx + 3) % 24 as slot from v_truth_objects) d on d.sample_id = e.sample_id and d.obj_idx = e.dest_track_id
""")
def slot_remap(v):
    given = v["v_truth_objects"].withColumn("slot", (F.col("obj_idx") + 3) % 24)
    return match.slot_remap(v["v_truth"], given).select(
        "gt_id", "agent_track_id", "target_track_id", "source_track_id", "dest_track_id"
    )


@query("slot_object_cost", """
select s.sample_id, s.slot, o.category_id, o.n_objects,
  round(-ln(greatest(exp(cast(cat_logits[o.category_id + 1] as double)) / list_sum(list_transform(cat_logits, lambda x: exp(cast(x as double)))), 1e-8)) - 0.5e0 * ln(greatest(existence, 1e-8)), 6) as cost
from v_slots s join (select sample_id, category_id, count(*) as n_objects from v_truth_objects group by all) o on o.sample_id = s.sample_id
""")
def slot_object_cost(v):
    return match.slot_object_costs(v["v_slots"], v["v_truth_objects"]).withColumn("cost", F.round("cost", 6))


def _nll(head: str, target: str) -> str:
    return (
        f"-ln(greatest(exp(cast({head}[{target} + 1] as double)) / list_sum(list_transform({head}, lambda x: exp(cast(x as double)))), 1e-8))"
    )


@query("event_match_cost", f"""
select p.sample_id, p.q, t.action_class, t.agent_track_id, t.target_track_id, t.n_gt,
  round({_nll('p.action', 't.action_class')} {_nll('p.agent_ptr', 't.agent_track_id')} {_nll('p.target_ptr', 't.target_track_id')}, 6) as cost
from v_pred p join (select sample_id, action_class, agent_track_id, target_track_id, count(*) as n_gt from v_truth group by all) t on t.sample_id = p.sample_id
""")
def event_match_cost(v):
    return match.event_match_costs(v["v_pred"], v["v_truth"]).withColumn("cost", F.round("cost", 6))


def _queries_sql(with_frame: bool) -> str:
    """CTEs up to qm: (sample_id, q, gt_id, cost) of the first optimal assignment of queries to truths."""
    kind = ["action_class", "agent_track_id", "target_track_id", *(["event_frame_index"] if with_frame else [])]
    terms = " ".join(_nll(f"p.{h}", f"t.{k}") for h, k in zip(("action", "agent_ptr", "target_ptr", "frame"), kind, strict=False))
    cols = ", ".join(kind)
    return f"""
tr as materialized (select *, case when j > 0 and lag(({cols})) over (partition by sample_id order by j) = ({cols}) then j - 1 end as prev
  from (select *, row_number() over (partition by sample_id order by {cols}, gt_id) - 1 as j from v_truth) t),
qs as materialized (select sample_id, q, row_number() over (partition by sample_id order by q) as i from v_pred semi join v_truth using (sample_id)),
qc as materialized (select p.sample_id, s.i, t.j, {terms} as cost, cast(round(cost * 1e9) as bigint) as ic
  from v_pred p join qs s using (sample_id, q) join tr t using (sample_id)),
{pairing("qp", "qs", "tr", "qc", "sample_id")},
qm as materialized (select sample_id, q, gt_id, cost from qp join qs using (sample_id, i) join tr using (sample_id, j) join qc using (sample_id, i, j))
"""


QUERIES_SQL, QUERIES_FRAME_SQL = _queries_sql(False), _queries_sql(True)

SLOTS_SQL = f"""
ob as materialized (select *, case when j > 0 and lag(category_id) over (partition by sample_id order by j) = category_id then j - 1 end as prev
  from (select *, row_number() over (partition by sample_id order by category_id, obj_idx) - 1 as j from v_truth_objects) t),
sl as materialized (select sample_id, slot, row_number() over (partition by sample_id order by slot) as i from v_slots semi join v_truth_objects using (sample_id)),
sc as materialized (select s.sample_id, l.i, o.j, -ln(greatest(exp(cast(cat_logits[o.category_id + 1] as double)) / list_sum(list_transform(cat_logits, lambda x: exp(cast(x as double)))), 1e-8))
    - 0.5e0 * ln(greatest(existence, 1e-8)) as cost, cast(round(cost * 1e9) as bigint) as ic from v_slots s join sl l using (sample_id, slot) join ob o using (sample_id)),
{pairing("sp", "sl", "ob", "sc", "sample_id")},
sm as materialized (select sample_id, slot, obj_idx, cost from sp join sl using (sample_id, i) join ob using (sample_id, j) join sc using (sample_id, i, j))
"""


@query("match_queries", f"with recursive {QUERIES_SQL} select sample_id, q, gt_id, round(cost, 6) as cost from qm")
def match_queries(v):
    return match.match_queries(v["v_pred"], v["v_truth"]).withColumn("cost", F.round("cost", 6))


@query("match_slots", f"with recursive {SLOTS_SQL} select sample_id, slot, obj_idx, round(cost, 6) as cost from sm")
def match_slots(v):
    return match.match_slots(v["v_slots"], v["v_truth_objects"]).withColumn("cost", F.round("cost", 6))


_ARG = ", ".join(
    f"cast(list_position({h}, list_max({h})) - 1 as int) as {h}"
    for h in ("action", "agent_ptr", "target_ptr", "source_ptr", "dest_ptr", "frame")
)


@query("events_from_predictions", f"""
select sample_id, q, case when action < 3 then (['pick', 'place', 'open'])[action + 1] else concat('action_', action) end as action,
  case when agent_ptr < 4 then (agent_ptr + 1) * 10 else agent_ptr end as agent_track_id,
  case when target_ptr < 4 then (target_ptr + 1) * 10 else target_ptr end as target_track_id,
  case when source_ptr < 4 then (source_ptr + 1) * 10 end as source_track_id,
  case when dest_ptr < 4 then (dest_ptr + 1) * 10 end as destination_track_id,
  case when frame < 6 then frame * 5 else frame end as frame, round(score, 6) as confidence
from (select sample_id, q, 1 / (1 + exp(-interaction)) as score, {_ARG} from v_pred) p where score >= 0.5
""")
def events_from_predictions(v):
    names = v.spark.createDataFrame([(0, "pick"), (1, "place"), (2, "open")], "id int, name string")
    slots = decode.slot_literal({0: 10, 1: 20, 2: 30, 3: 40})
    frames = F.array(*[F.lit(i * 5) for i in range(6)])
    out = decode.events_from_predictions(v["v_pred"], slots, 6, names, frames)
    return out.withColumn("confidence", F.round("confidence", 6))
