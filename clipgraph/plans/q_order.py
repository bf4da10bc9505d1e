"""Ordering, splits, limits and set operations (G rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.operators import attention, ordering, selection, validate, windows
from clipgraph.plans.registry import query
from clipgraph.sources import inventory


@query("global_index", "select event_id, row_number() over (order by ts, event_id) - 1 as idx from events")
def global_index(v):
    return ordering.row_index(v["events"].select("event_id", "ts"), ["ts", "event_id"], name="idx").select("event_id", "idx")


_SHUFFLED = """
(select sample_id, row_number() over (order by md5(concat(sample_id, '|42')), sample_id) - 1 as pos, (select count(*) from documents) as n from v_samples)
"""


@query("split_80_10_10", f"""
select sample_id, case when pos < floor(n * 0.8e0) then 'train' when pos < floor(n * 0.8e0) + floor(n * 0.1e0) then 'val' else 'test' end as split from {_SHUFFLED} s
""")
def split_80_10_10(v):
    return ordering.seeded_split(v["v_samples"].select("sample_id"), "sample_id").select("sample_id", "split")


@query("split_holdout", f"""
select sample_id, case when pos < n - 2 * floor(n * 0.1e0) then 'train' when pos < n - floor(n * 0.1e0) then 'val' else 'test' end as split from {_SHUFFLED} s
""")
def split_holdout(v):
    return ordering.seeded_split(v["v_samples"].select("sample_id"), "sample_id", train=None).select("sample_id", "split")


_BATCH = "(select sample_id, n_bytes, row_number() over (order by sample_id) - 1 as pos, count(*) over () as n from v_samples)"


@query("batching", f"""
select cast(pos // 16 as bigint) as batch_index, count(*) as n, cast(sum(n_bytes) as bigint) as n_bytes, string_agg(sample_id, ',' order by sample_id) as samples
from {_BATCH} b group by 1
""")
def batching(v):
    placed = ordering.batch_index(v["v_samples"].select("sample_id", "n_bytes"), ["sample_id"], 16)
    return placed.groupBy("batch_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"),
        F.array_join(F.sort_array(F.collect_list("sample_id")), ",").alias("samples"),
    )


@query("batching_drop_last", f"""
select cast(pos // 16 as bigint) as batch_index, count(*) as n from {_BATCH} b where pos // 16 < n // 16 group by 1
""")
def batching_drop_last(v):
    placed = ordering.batch_index(v["v_samples"].select("sample_id"), ["sample_id"], 16, drop_last=True)
    return placed.groupBy("batch_index").agg(F.count(F.lit(1)).alias("n"))


@query("order_events", """
select event_seq, row_number() over (partition by clip_id order by frame, event_seq) - 1 as sorted_pos, max(b) over (partition by clip_id) as resorted
from (select *, coalesce(lag(frame) over (partition by clip_id order by event_seq) > frame, false) as b from v_ann_events) e
""")
def order_events(v):
    return validate.order_events(v["v_ann_events"], "clip_id", "frame", "event_seq").select("event_seq", "sorted_pos", "resorted")


@query("smallest_n", """
select source as video_id, count(*) as n_clips from documents group by 1 order by n_clips, video_id limit 5
""")
def smallest_n(v):
    sizes = v["documents"].groupBy(F.col("source").alias("video_id")).agg(F.count(F.lit(1)).alias("n_clips"))
    return inventory.smallest(sizes, "n_clips", "video_id", 5)


@query("ranked_extremes", """
with e as (select sample_id, t, y, x, -sum(w * ln(w + 1e-10)) as entropy from v_attn group by all)
select * from (select sample_id, t, y, x, round(entropy, 6) as entropy, 'low' as side from e order by e.entropy, sample_id, t, y, x limit 5) a
union all select * from (select sample_id, t, y, x, round(entropy, 6) as entropy, 'high' as side from e order by e.entropy desc, sample_id, t, y, x limit 5) b
""")
def ranked_extremes(v):
    out = attention.ranked_extremes(attention.token_entropy(v["v_attn"]), "entropy", ["sample_id", "t", "y", "x"], 5)
    return out.withColumn("entropy", F.round("entropy", 6))


@query("top_slots", """
select sample_id, slot, cast(rank as int) as rank from (select sample_id, slot, row_number() over (partition by sample_id order by existence desc, slot) as rank from v_slots) r where rank <= 3
""")
def top_slots(v):
    return attention.top_slots(v["v_slots"], 3).select("sample_id", "slot", "rank")


SELECTED_ACTIONS = ["click", "purchase", "signup", "view"]


def _selection_sql() -> str:
    """One CTE a choice, each of which sees those before it."""
    ctes = ["""
base as materialized (
  select c.video_id, c.clip_index, c.n_events, case when c.n_events = 0 and c.n_objects = 0 then 'motion_filtered' else 'annotated' end as status, coalesce(acts, []) as acts,
    md5(concat(c.video_id, '|', c.clip_index, '|42')) as tie
  from v_ann_clips c left join (select video_id, clip_index, list(distinct action) as acts from v_gt where action <> 'error' group by all) g
    on g.video_id = c.video_id and g.clip_index = c.clip_index),
c0 as (select null::bigint as video_id, null::int as clip_index, '' as reason where false)"""]
    strata = [(f"action_type:{a}", f"list_contains(acts, '{a}')", "-len(acts)", "1", True) for a in SELECTED_ACTIONS]
    strata += [
        ("fill_event", "len(acts) > 0", "-n_events", f"15 - (select count(*) from c{len(strata)})", False),
        ("no_event_annotated", "status = 'annotated' and len(acts) = 0 and n_events = 0", "0", "5", False),
        ("motion_filtered", "status = 'motion_filtered'", "0", "5", False),
    ]
    for k, (name, where, weight, quota, again) in enumerate(strata):
        taken = f"exists (select 1 from c{k} t where t.video_id = b.video_id and t.clip_index = b.clip_index)"
        seen = f"b.video_id in (select video_id from c{k})"
        ctes.append(f"""
c{k + 1} as materialized (select * from c{k} union all select video_id, clip_index, '{name}' from (
  select *, row_number() over (order by {taken}, {seen}, {weight}, tie) as place from base b where {where} {'' if again else f'and not {taken}'}) p where place <= {quota})""")
    return f"with {','.join(ctes)} select video_id, clip_index, reason as selection_reason from c{len(strata)}"


@query("stratified_select", _selection_sql())
def stratified_select(v):
    return selection.stratified_select(selection_clips(v), SELECTED_ACTIONS)


def selection_clips(v):
    """Clips with their distinct actions (a bounded set), event counts and status."""
    seen = v["v_gt"].where("action <> 'error'").groupBy(F.col("video_id").cast("bigint").alias("video_id"), "clip_index").agg(
        F.collect_set("action").alias("actions")
    )
    from clipgraph.functions import ids

    status = ids.clip_status(F.col("n_objects"), F.col("n_events"))
    out = v["v_ann_clips"].join(seen, ["video_id", "clip_index"], "left")
    return out.select(
        "video_id", "clip_index", "n_events", status.alias("status"),
        F.coalesce("actions", F.array().cast("array<string>")).alias("actions"),
    )


@query("middle_clip", """
select video_id, clip_index, n_sampled from (select video_id, clip_index, n as n_sampled, row_number() over (partition by video_id order by clip_index) as rn, count(*) over (partition by video_id) as c from v_clips) m
where rn = c // 2 + 1
""")
def middle_clip(v):
    clips = windows.clip_windows(v["v_videos"], by="video_id").select("video_id", "clip_index", "n_sampled")
    return selection.middle_clip(clips)


@query("set_ops", """
select 'both' as part, count(*) as n from (select o_orderkey from orders intersect select l_orderkey from lineitem) a
union all select 'only_orders', count(*) from (select o_orderkey from orders except select l_orderkey from lineitem) b
union all select 'either', count(*) from (select o_orderkey from orders union select l_orderkey from lineitem) c
""")
def set_ops(v):
    """Intersection, difference and union sizes of two key sets from one tagged aggregate."""
    tagged = v["orders"].select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        v["lineitem"].select(F.col("l_orderkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    found = tagged.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = found.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_orders"),
        F.count(F.lit(1)).alias("either"),
    )
    return n.select(F.expr("stack(3, 'both', both, 'only_orders', only_orders, 'either', either) as (part, n)"))
