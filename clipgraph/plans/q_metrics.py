"""Evaluation metrics (M rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import arrays
from clipgraph.operators import metrics
from clipgraph.plans.q_match import QUERIES_FRAME_SQL, QUERIES_SQL, SLOTS_SQL
from clipgraph.plans.registry import query

_AM = lambda c: f"cast(list_position({c}, list_max({c})) - 1 as int)"


@query("accuracy", """
select round(avg(case when list_position(embedding[1:10], list_max(embedding[1:10])) - 1 = label then 1.0e0 else 0.0e0 end), 6) as accuracy from embeddings
""")
def accuracy(v):
    scored = v["embeddings"].select(F.slice("embedding", 1, 10).alias("logits"), "label")
    return metrics.accuracy(scored, "logits", "label").select(F.round("accuracy", 6).alias("accuracy"))


@query("average_precision", """
with r as (select row_number() over (order by -value, event_id) as rank, case when event_type = 'purchase' then 1.0e0 else 0.0e0 end as y from events where value is not null),
c as (select rank, y, sum(y) over (order by rank rows unbounded preceding) as tp from r),
p as (select rank, tp / (rank + 1e-8) * y as h, tp / ((select sum(y) from r) + 1e-8) as rec from c),
t as (select (rec - lag(rec) over (order by rank)) * (h + lag(h) over (order by rank)) / 2 as area from p)
select round(coalesce(sum(area), 0), 6) as average_precision from t
""")
def average_precision(v):
    rows = v["events"].where("value is not null").select(
        "event_id", "value", (F.col("event_type") == "purchase").cast("int").alias("y")
    )
    out = metrics.average_precision(rows, "value", "y", "event_id")
    return out.select(F.round("average_precision", 6).alias("average_precision"))


@query("detection_labels", f"""
with recursive {QUERIES_SQL} select p.sample_id, p.q, round(1 / (1 + exp(-p.interaction)), 6) as score, case when m.q is null then 0.0e0 else 1.0e0 end as label
from v_pred p left join qm m on m.sample_id = p.sample_id and m.q = p.q
""")
def detection_labels(v):
    return metrics.detection_labels(v["v_pred"], v["v_truth"]).withColumn("score", F.round("score", 6))


_ACTIVE = f"""
(select row_number() over (order by sample_id, q) - 1 as pos, sample_id, {_AM('action')} as action_class, {_AM('agent_ptr')} as agent_track_id,
   {_AM('target_ptr')} as target_track_id, {_AM('frame')} as event_frame_index from v_pred where 1 / (1 + exp(-interaction)) > 0.5)
"""
_TRUTH = "(select row_number() over (order by sample_id, gt_id) - 1 as pos, * from v_truth)"


@query("action_accuracy", f"""
select round(coalesce(avg(case when a.action_class = b.action_class then 1.0e0 else 0.0e0 end), 0), 6) as action_accuracy from {_ACTIVE} a join {_TRUTH} b on a.pos = b.pos
""")
def action_accuracy(v):
    return metrics.action_accuracy(v["v_pred"], v["v_truth"]).select(F.round("action_accuracy", 6).alias("action_accuracy"))


@query("pointer_accuracy", f"""
select round(coalesce(sum((case when a.agent_track_id = b.agent_track_id then 1.0e0 else 0.0e0 end) + (case when a.target_track_id = b.target_track_id then 1.0e0 else 0.0e0 end)), 0)
  / greatest(2 * count(*), 1), 6) as pointer_accuracy from {_ACTIVE} a join {_TRUTH} b on a.pos = b.pos
""")
def pointer_accuracy(v):
    return metrics.pointer_accuracy(v["v_pred"], v["v_truth"]).select(F.round("pointer_accuracy", 6).alias("pointer_accuracy"))


@query("frame_mae", f"""
select round(coalesce(avg(abs(a.event_frame_index - b.event_frame_index)), 0), 6) as frame_mae from {_ACTIVE} a join {_TRUTH} b on a.pos = b.pos
""")
def frame_mae(v):
    return metrics.frame_mae(v["v_pred"], v["v_truth"]).select(F.round("frame_mae", 6).alias("frame_mae"))


_F1 = """
select np as n_pred, ng as n_gt, tp, round(case when np = 0 and ng = 0 then 1 when tp = 0 then 0 else 2.0e0 * tp / (np + ng) end, 6) as graph_f1
from (select (select count(*) from p) as np, (select count(*) from g) as ng, (select count(*) from (select * from p intersect select * from g) i) as tp) c
"""


@query("graph_f1", f"""
with p as (select distinct agent_track_id, action, target_track_id from v_edges where event_seq % 2 = 1),
g as (select distinct agent_track_id, action, target_track_id from v_edges where event_seq % 2 = 0) {_F1}
""")
def graph_f1(v):
    edges = v["v_edges"]
    odd = F.col("event_seq") % 2 == 1
    out = metrics.graph_f1(edges.where(odd), edges.where(~odd), ["agent_track_id", "action", "target_track_id"])
    return out.withColumn("graph_f1", F.round("graph_f1", 6)).select(
        F.col("n_pred").cast("bigint").alias("n_pred"), F.col("n_gt").cast("bigint").alias("n_gt"), "tp", "graph_f1"
    )


@query("graph_f1_by_video", f"""
with p as (select distinct video_id, agent_track_id, action, target_track_id from v_edges where event_seq % 2 = 1),
g as (select distinct video_id, agent_track_id, action, target_track_id from v_edges where event_seq % 2 = 0) {_F1}
""")
def graph_f1_by_video(v):
    """The corrected form: edges of different videos are different edges."""
    edges = v["v_edges"]
    odd = F.col("event_seq") % 2 == 1
    out = metrics.graph_f1(
        edges.where(odd), edges.where(~odd), ["agent_track_id", "action", "target_track_id"], ["video_id"]
    )
    return out.withColumn("graph_f1", F.round("graph_f1", 6)).select(
        F.col("n_pred").cast("bigint").alias("n_pred"), F.col("n_gt").cast("bigint").alias("n_gt"), "tp", "graph_f1"
    )


@query("metric_suite", f"""
select 'action_accuracy' as metric, round(coalesce(avg(case when a.action_class = b.action_class then 1.0e0 else 0.0e0 end), 0), 6) as value from {_ACTIVE} a join {_TRUTH} b on a.pos = b.pos
union all select 'frame_mae', round(coalesce(avg(abs(a.event_frame_index - b.event_frame_index)), 0), 6) from {_ACTIVE} a join {_TRUTH} b on a.pos = b.pos
union all select 'graph_f1', (with p as (select distinct agent_track_id, action_class, target_track_id from {_ACTIVE} a), g as (select distinct agent_track_id, action_class, target_track_id from v_truth)
  select round(case when (select count(*) from (select * from p intersect select * from g) i) = 0 then 0
    else 2.0e0 * (select count(*) from (select * from p intersect select * from g) i) / ((select count(*) from p) + (select count(*) from g)) end, 6))
""")
def metric_suite(v):
    out = metrics.metric_suite(v["v_pred"], v["v_truth"], ["action_accuracy", "frame_mae", "graph_f1"])
    return out.withColumn("value", F.round("value", 6))


@query("metric_suite_all", f"""
with recursive {QUERIES_SQL},
ap_r as (select row_number() over (order by -1 / (1 + exp(-p.interaction)), p.sample_id, p.q) as rank, case when m.q is null then 0.0e0 else 1.0e0 end as y
  from v_pred p left join qm m on m.sample_id = p.sample_id and m.q = p.q),
ap_c as (select rank, y, sum(y) over (order by rank rows unbounded preceding) as tp from ap_r),
ap_p as (select rank, tp / (rank + 1e-8) * y as h, tp / ((select sum(y) from ap_r) + 1e-8) as rec from ap_c),
ap_t as (select (rec - lag(rec) over (order by rank)) * (h + lag(h) over (order by rank)) / 2 as area from ap_p),
act as materialized (select * from {_ACTIVE} a), tru as materialized (select * from {_TRUTH} b),
pr2 as materialized (select a.action_class as a0, b.action_class as b0, a.agent_track_id as a1, b.agent_track_id as b1, a.target_track_id as a2, b.target_track_id as b2,
  a.event_frame_index as a3, b.event_frame_index as b3 from act a join tru b on a.pos = b.pos),
gp as (select distinct agent_track_id, action_class, target_track_id from act), gg as (select distinct agent_track_id, action_class, target_track_id from tru),
gn as (select (select count(*) from gp) as np, (select count(*) from gg) as ng, (select count(*) from (select * from gp intersect select * from gg) i) as tp)
select 'event_detection_map' as metric, round(coalesce(sum(area), 0), 6) as value from ap_t
union all select 'action_accuracy', round(coalesce(avg(case when a0 = b0 then 1.0e0 else 0.0e0 end), 0), 6) from pr2
union all select 'pointer_accuracy', round(coalesce(sum((case when a1 = b1 then 1.0e0 else 0.0e0 end) + (case when a2 = b2 then 1.0e0 else 0.0e0 end)), 0) / greatest(2 * count(*), 1), 6) from pr2
union all select 'frame_mae', round(coalesce(avg(abs(a3 - b3)), 0), 6) from pr2
union all select 'graph_f1', round(case when np = 0 and ng = 0 then 1 when tp = 0 then 0 else 2.0e0 * tp / (np + ng) end, 6) from gn
""")
def metric_suite_all(v):
    return metrics.metric_suite(v["v_pred"], v["v_truth"]).withColumn("value", F.round("value", 6))


@query("metric_inputs", f"""
select 'pred' as side, pos, action_class, agent_track_id, target_track_id, event_frame_index from {_ACTIVE} a
union all select 'gt', pos, action_class, agent_track_id, target_track_id, event_frame_index from {_TRUTH} b
""")
def metric_inputs(v):
    return metrics.metric_inputs(v["v_pred"], v["v_truth"])


def _rounded_losses(out):
    return out.select(*[F.round(c, 6).alias(c) for c in metrics.LOSS_WEIGHTS], "n_matched", F.round("total", 5).alias("total"))


def _given_pairs(v):
    """Each truth with the query of its own row: a fixed pairing, so that the losses have a SQL form."""
    return v["v_truth"].select("sample_id", "gt_id", (F.col("gt_id") % 20).alias("q"))


def _ce(head: str, target: str) -> str:
    return f"avg(ln(list_sum(list_transform({head}, lambda x: exp(cast(x as double))))) - cast({head}[{target} + 1] as double))"


@query("scoring_losses_paired", f"""
with j as (select p.*, t.gt_id, t.action_class, t.agent_track_id, t.target_track_id, coalesce(t.source_track_id, 6) as src, coalesce(t.dest_track_id, 6) as dst, t.event_frame_index
  from v_pred p left join v_truth t on t.sample_id = p.sample_id and t.gt_id % 20 = p.q),
i as (select avg(l) as interaction from (select sample_id, avg(greatest(interaction, 0) - interaction * (case when gt_id is null then 0 else 1 end) + ln(1 + exp(-abs(interaction)))) as l from j group by 1) s),
h as (select {_ce('action', 'action_class')} as action, {_ce('agent_ptr', 'agent_track_id')} as agent_ptr, {_ce('target_ptr', 'target_track_id')} as target_ptr,
  {_ce('source_ptr', 'src')} as source_ptr, {_ce('dest_ptr', 'dst')} as dest_ptr, {_ce('frame', 'event_frame_index')} as frame, count(*) as n_matched from j where gt_id is not null)
select round(interaction, 6) as interaction, round(action, 6) as action, round(agent_ptr, 6) as agent_ptr, round(target_ptr, 6) as target_ptr, round(source_ptr, 6) as source_ptr,
  round(dest_ptr, 6) as dest_ptr, round(frame, 6) as frame, n_matched,
  round(2 * interaction + action + agent_ptr + target_ptr + 0.5 * source_ptr + 0.5 * dest_ptr + 0.5 * frame, 5) as total from i, h
""")
def scoring_losses_paired(v):
    return _rounded_losses(metrics.scoring_losses(v["v_pred"], v["v_truth"], matched=_given_pairs(v)))


@query("scoring_losses", f"""
with recursive {QUERIES_FRAME_SQL},
j as (select p.*, t.gt_id, t.action_class, t.agent_track_id, t.target_track_id, coalesce(t.source_track_id, 6) as src, coalesce(t.dest_track_id, 6) as dst, t.event_frame_index
  from v_pred p left join qm on qm.sample_id = p.sample_id and qm.q = p.q left join v_truth t on t.sample_id = qm.sample_id and t.gt_id = qm.gt_id),
i as (select avg(l) as interaction from (select sample_id, avg(greatest(interaction, 0) - interaction * (case when gt_id is null then 0 else 1 end) + ln(1 + exp(-abs(interaction)))) as l from j group by 1) s),
h as (select {_ce('action', 'action_class')} as action, {_ce('agent_ptr', 'agent_track_id')} as agent_ptr, {_ce('target_ptr', 'target_track_id')} as target_ptr,
  {_ce('source_ptr', 'src')} as source_ptr, {_ce('dest_ptr', 'dst')} as dest_ptr, {_ce('frame', 'event_frame_index')} as frame, count(*) as n_matched from j where gt_id is not null)
select round(interaction, 6) as interaction, round(action, 6) as action, round(agent_ptr, 6) as agent_ptr, round(target_ptr, 6) as target_ptr, round(source_ptr, 6) as source_ptr,
  round(dest_ptr, 6) as dest_ptr, round(frame, 6) as frame, n_matched,
  round(2 * interaction + action + agent_ptr + target_ptr + 0.5 * source_ptr + 0.5 * dest_ptr + 0.5 * frame, 5) as total from i, h
""")
def scoring_losses(v):
    return _rounded_losses(metrics.scoring_losses(v["v_pred"], v["v_truth"]))


@query("slot_losses", f"""
with recursive {SLOTS_SQL},
j as (select s.*, o.category_id from v_slots s left join sm on sm.sample_id = s.sample_id and sm.slot = s.slot left join v_truth_objects o on o.sample_id = sm.sample_id and o.obj_idx = sm.obj_idx)
select round((select sum(ln(list_sum(list_transform(cat_logits, lambda x: exp(cast(x as double))))) - cast(cat_logits[category_id + 1] as double)) from j where category_id is not null)
    / greatest((select count(*) from v_truth_objects), 1), 6) as category,
  round(avg(e), 6) as existence from (select sample_id, avg(-(case when category_id is null then ln(1 - existence) else ln(existence) end)) as e from j group by 1) x
""")
def slot_losses(v):
    out = metrics.slot_losses(v["v_slots"], v["v_truth_objects"])
    return out.select(F.round("category", 6).alias("category"), F.round("existence", 6).alias("existence"))


@query("slot_losses_paired", f"""
with j as (select s.*, o.category_id from v_slots s left join v_truth_objects o on o.sample_id = s.sample_id and o.obj_idx = s.slot)
select round((select sum(ln(list_sum(list_transform(cat_logits, lambda x: exp(cast(x as double))))) - cast(cat_logits[category_id + 1] as double)) from j where category_id is not null)
    / greatest((select count(*) from v_truth_objects), 1), 6) as category,
  round(avg(e), 6) as existence from (select sample_id, avg(-(case when category_id is null then ln(1 - existence) else ln(existence) end)) as e from j group by 1) x
""")
def slot_losses_paired(v):
    given = v["v_truth_objects"].select("sample_id", "obj_idx", F.col("obj_idx").alias("slot"))
    out = metrics.slot_losses(v["v_slots"], v["v_truth_objects"], matched=given)
    return out.select(F.round("category", 6).alias("category"), F.round("existence", 6).alias("existence"))
