"""Matching of objects, events, slots and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays
from clipgraph.operators.assignment import assign_groups
from clipgraph.operators.ordering import row_index
from clipgraph.operators.tracks import separation_in
from clipgraph.operators.windows import explode_range


def candidate_pairs(objects: DataFrame, detections: DataFrame) -> DataFrame:
    """Objects with the tracks of their category present at their first frame, and the match score.

    An object has no box of its own, so all objects of one category and first frame share
    their candidates. Only the boxes of a wanted frame and category are scored.
    """
    key = ["video_id", "first_seen_frame", "_cat"]
    wanted = objects.withColumn("_cat", F.lower("category"))
    boxes = detections.withColumnsRenamed({"frame_index": "first_seen_frame"}).withColumn("_cat", F.lower("category"))
    # the boxes move once: what they are wanted by, compared by and joined by is one key
    seen = boxes.join(wanted.select(*key).distinct(), key, "left_semi")
    scored = separation_in(seen, key).select(*key, "track_id", "match_score")
    return wanted.join(scored, key).drop("_cat")


def align(objects: DataFrame, detections: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Optimal object-to-track mapping per video as (video_id, obj_id, track_id, score).

    Objects match only tracks of their own category, so the assignment splits by (video,
    category); pairs with score 0 add nothing to it and are not listed.
    """
    kinds = objects.withColumn("_cat", F.lower("category"))
    counted = kinds.groupBy("video_id", "_cat", "first_seen_frame").agg(F.count(F.lit(1)).alias("n_objects"))
    pairs = candidate_pairs(counted.withColumn("category", F.col("_cat")).drop("_cat"), detections)
    solved = assign_groups(
        pairs.withColumn("cost", 1 - F.col("match_score")),
        ["video_id", "category"], "first_seen_frame", "track_id", left_n="n_objects",
    )
    kept = explode_range(solved.where(1 - F.col("cost") >= threshold), F.col("n"), "_i")
    wanted = kept.select(
        "video_id", F.col("category").alias("_cat"), "first_seen_frame",
        (F.col("left_from") + F.col("_i")).alias("_at"), "track_id", (1 - F.col("cost")).alias("score"),
    )
    # Which of several alike objects takes which track is free; the first ids do.
    placed = row_index(kinds, ["obj_id"], ["video_id", "_cat", "first_seen_frame"], name="_at")
    return placed.join(wanted, ["video_id", "_cat", "first_seen_frame", "_at"]).select("video_id", "obj_id", "track_id", "score")


def alignment_summary(objects: DataFrame, detections: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per video: matched, unmatched on both sides and the confidence.

    The confidence is the mean score of the matches, 0 without any, and 1 for a video without
    objects.
    """
    n_obj = objects.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_objects"))
    n_trk = detections.groupBy("video_id").agg(F.count_distinct("track_id").alias("n_tracks"))
    matched = mapping.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_matched"), F.avg("score").alias("_mean"))
    row = n_obj.join(n_trk, "video_id", "full").join(matched, "video_id", "left")
    zero = F.lit(0)
    return row.select(
        "video_id",
        F.coalesce("n_matched", zero).alias("n_matched"),
        (F.coalesce("n_objects", zero) - F.coalesce("n_matched", zero)).alias("unmatched_objects"),
        (F.coalesce("n_tracks", zero) - F.coalesce("n_matched", zero)).alias("unmatched_tracks"),
        F.when(F.coalesce("n_objects", zero) == 0, F.lit(1.0)).otherwise(F.coalesce("_mean", F.lit(0.0))).alias("confidence"),
    )


def match_objects(truth: DataFrame, pred: DataFrame, clip: list[str], category: str, ident: str) -> DataFrame:
    """Pairs of equal category per clip, as many as the smaller side has.

    With a 0/1 cost by category the optimum is to pair the k-th truth with the k-th prediction
    of each category.
    """
    key = [*clip, category]
    a = row_index(truth.select(*key, F.col(ident).alias("gt_id")), ["gt_id"], key, name="_k")
    b = row_index(pred.select(*key, F.col(ident).alias("pred_id")), ["pred_id"], key, name="_k")
    return a.join(b, [*key, "_k"]).drop("_k")


def event_cost(
    gt_frame: Column, frame: Column, same_action: Column, same_agent: Column, same_target: Column
) -> Column:
    """Action mismatch 1, frame distance over 16 (at most 1), agent and target category mismatch 0.5 each."""
    miss = lambda same, w: F.when(same, F.lit(0.0)).otherwise(F.lit(w))
    far = F.least(F.abs(gt_frame - frame) / 16.0, F.lit(1.0))
    return miss(same_action, 1.0) + far + miss(same_agent, 0.5) + miss(same_target, 0.5)


EVENT_KIND = ["action", "frame", "agent_category", "target_category"]


def event_kinds(events: DataFrame, clip: list[str]) -> DataFrame:
    """Distinct (action, local frame, agent category, target category) per clip with their counts.

    All four come from small vocabularies, so the kinds of a clip are bounded while its events are not.
    """
    blank = events.withColumns({c: F.coalesce(c, F.lit("")) for c in ("agent_category", "target_category")})
    return blank.groupBy(*clip, *EVENT_KIND).agg(F.count(F.lit(1)).alias("n"))


def event_costs(truth: DataFrame, pred: DataFrame, clip: list[str]) -> DataFrame:
    """Cost of every truth kind against every predicted kind of the same clip, with their counts."""
    a = event_kinds(truth, clip).select(*clip, F.struct(*EVENT_KIND).alias("gt"), F.col("n").alias("n_gt"))
    b = event_kinds(pred, clip).select(*clip, F.struct(*EVENT_KIND).alias("pred"), F.col("n").alias("n_pred"))
    cost = event_cost(
        F.col("gt.frame"), F.col("pred.frame"), F.col("gt.action") == F.col("pred.action"),
        F.col("gt.agent_category") == F.col("pred.agent_category"),
        F.col("gt.target_category") == F.col("pred.target_category"),
    )
    return a.join(b, clip).withColumn("cost", cost)


def _kind_text(kind: str) -> Column:
    """An event kind as a text that sorts like its four fields."""
    frame = F.lpad((F.col(f"{kind}.frame").cast("bigint") + F.lit(1 << 33)).cast("string"), 10, "0")
    return F.concat_ws("\x01", f"{kind}.action", frame, f"{kind}.agent_category", f"{kind}.target_category")


def match_event_kinds(truth: DataFrame, pred: DataFrame, clip: list[str], below: float = 2.0) -> DataFrame:
    """Optimal assignment of event kinds per clip with the matched count ``n``; only costs under ``below``.

    Kinds are lines in the order of action, frame, agent and target category, which decides among equal optima.
    """
    named = event_costs(truth, pred, clip).withColumns({"gt_kind": _kind_text("gt"), "pred_kind": _kind_text("pred")})
    solved = assign_groups(named, clip, "gt_kind", "pred_kind", "cost", "n_gt", "n_pred", missing=3.0)

    def kind(text: str) -> Column:
        at = F.split(text, "\x01")
        frame = (at[1].cast("bigint") - F.lit(1 << 33)).cast(truth.schema["frame"].dataType)
        return F.struct(at[0].alias("action"), frame.alias("frame"), at[2].alias("agent_category"), at[3].alias("target_category"))

    return solved.where(F.col("cost") < below).withColumns({"gt": kind("gt_kind"), "pred": kind("pred_kind")})


def match_events(truth: DataFrame, pred: DataFrame, clip: list[str], ident: str, below: float = 2.0) -> DataFrame:
    """Matched events as (clip, gt_id, pred_id, cost): kinds are matched, then spread over their rows."""
    kinds = match_event_kinds(truth, pred, clip, below)
    units = explode_range(kinds, F.col("n"), "_i")
    pairs = units.select(
        *clip, "gt", "pred", "cost",
        (F.col("left_from") + F.col("_i")).alias("_a"), (F.col("right_from") + F.col("_i")).alias("_b"),
    )

    def placed(events: DataFrame, out: str, kind: str, at: str) -> DataFrame:
        blank = events.withColumns({c: F.coalesce(c, F.lit("")) for c in ("agent_category", "target_category")})
        ranked = row_index(blank.select(*clip, *EVENT_KIND, F.col(ident).alias(out)), [out], [*clip, *EVENT_KIND], name=at)
        return ranked.select(*clip, F.struct(*EVENT_KIND).alias(kind), out, at)

    a, b = placed(truth, "gt_id", "gt", "_a"), placed(pred, "pred_id", "pred", "_b")
    return pairs.join(a, [*clip, "gt", "_a"]).join(b, [*clip, "pred", "_b"]).select(*clip, "gt_id", "pred_id", "cost")


def clip_join(truth: DataFrame, pred: DataFrame, clip: list[str], frames: DataFrame | None = None) -> DataFrame:
    """Truth clips with the predicted clip of the same key (or none) and the clip's frame list (default 0..15)."""
    marked = pred.select(*clip).distinct().withColumn("has_prediction", F.lit(True))
    out = truth.join(marked, clip, "left").withColumn("has_prediction", F.coalesce("has_prediction", F.lit(False)))
    default = F.sequence(F.lit(0), F.lit(15))
    if frames is None:
        return out.withColumn("frame_indices", default)
    return out.join(frames.select(*clip, "frame_indices"), clip, "left").withColumn(
        "frame_indices", F.coalesce("frame_indices", default)
    )


def _neg_log(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-8)))


def slot_object_costs(slots: DataFrame, objects: DataFrame, key: str = "sample_id") -> DataFrame:
    """-log p(category) - 0.5 log(existence) of each slot for each category the sample has.

    Objects of one category cost the same, so they are one line with ``n_objects``.
    """
    kinds = objects.groupBy(key, "category_id").agg(F.count(F.lit(1)).alias("n_objects"))
    p = F.exp(arrays.log_softmax_at(F.col("cat_logits"), F.col("category_id")))
    cost = _neg_log(p) + 0.5 * _neg_log(F.col("existence"))
    return slots.join(kinds, key).select(key, "slot", "category_id", "n_objects", cost.alias("cost"))


TRUTH_KIND = ["action_class", "agent_track_id", "target_track_id"]


def event_match_costs(pred: DataFrame, truth: DataFrame, key: str = "sample_id", with_frame: bool = False) -> DataFrame:
    """-log p(action) - log p(agent) - log p(target) [- log p(frame)] of each query for each truth kind."""
    kind = [*TRUTH_KIND, *(["event_frame_index"] if with_frame else [])]
    kinds = truth.groupBy(key, *kind).agg(F.count(F.lit(1)).alias("n_gt"))
    heads = ["action", "agent_ptr", "target_ptr", *(["frame"] if with_frame else [])]
    cost = None
    for head, target in zip(heads, kind):
        term = _neg_log(F.exp(arrays.log_softmax_at(F.col(head), F.col(target))))
        cost = term if cost is None else cost + term
    return pred.join(kinds, key).select(key, "q", *kind, "n_gt", cost.alias("cost"))


def match_queries(pred: DataFrame, truth: DataFrame, key: str = "sample_id", with_frame: bool = False) -> DataFrame:
    """Optimal query-to-truth assignment per sample: (sample, q, gt_id, cost)."""
    kind = [*TRUTH_KIND, *(["event_frame_index"] if with_frame else [])]
    # a text that sorts like the numbers
    text = F.concat_ws("|", *[F.lpad((F.col(c).cast("bigint") + F.lit(1 << 33)).cast("string"), 10, "0") for c in kind])
    costs = event_match_costs(pred, truth, key, with_frame).withColumn("_kind", text)
    solved = assign_groups(costs, [key], "q", "_kind", "cost", right_n="n_gt")
    at = (F.col("right_from")).alias("_at")
    wanted = solved.select(key, "q", "_kind", "cost", at)
    ranked = row_index(truth.withColumn("_kind", text), ["gt_id"], [key, "_kind"], name="_at")
    return wanted.join(ranked.select(key, "_kind", "_at", "gt_id"), [key, "_kind", "_at"]).select(key, "q", "gt_id", "cost")


def match_slots(slots: DataFrame, objects: DataFrame, key: str = "sample_id") -> DataFrame:
    """Optimal slot-to-object assignment per sample: (sample, slot, obj_idx, cost)."""
    solved = assign_groups(slot_object_costs(slots, objects, key), [key], "slot", "category_id", right_n="n_objects")
    wanted = solved.select(key, "slot", "category_id", "cost", F.col("right_from").alias("_at"))
    ranked = row_index(objects, ["obj_idx"], [key, "category_id"], name="_at")
    return wanted.join(ranked, [key, "category_id", "_at"]).select(key, "slot", "obj_idx", "cost")


def slot_remap(events: DataFrame, matched: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rewrite event roles from object index to matched slot.

    Events whose agent or target has no slot go; an unmatched source or destination becomes null.
    """
    out = events
    for role, how in (("agent", "inner"), ("target", "inner"), ("source", "left"), ("dest", "left")):
        col = f"{role}_track_id"
        side = matched.select(F.col(key), F.col("obj_idx").alias(col), F.col("slot").alias(f"_{role}"))
        out = out.join(side, [key, col], how)
    roles = {f"{r}_track_id": F.col(f"_{r}") for r in ("agent", "target", "source", "dest")}
    return out.withColumns(roles).select(*events.columns)
