"""Quality reports: precision, recall, F1, accuracies and per-clip details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import ids
from clipgraph.operators import match
from clipgraph.session import settle
from clipgraph.vocab import AXES


def with_prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    p, r, f = ids.prf(F.col(tp), F.col(fp), F.col(fn))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f)


def object_counts(truth: DataFrame, pred: DataFrame, clip: list[str], category: str) -> DataFrame:
    """tp, fp, fn per clip and category: the smaller count matches, the rest is unmatched."""
    both = truth.select(*clip, category, F.lit(1).alias("_g"), F.lit(0).alias("_p")).unionByName(
        pred.select(*clip, F.coalesce(category, F.lit("unknown")).alias(category), F.lit(0).alias("_g"), F.lit(1).alias("_p"))
    )
    n = both.groupBy(*clip, category).agg(F.sum("_g").alias("_g"), F.sum("_p").alias("_p"))
    tp = F.least("_g", "_p")
    return n.select(*clip, category, tp.alias("tp"), (F.col("_p") - tp).alias("fp"), (F.col("_g") - tp).alias("fn"))


def prf_by(counts: DataFrame, key: list[str]) -> DataFrame:
    """Sum tp, fp, fn per key (all rows for an empty key) and add precision, recall and F1."""
    sums = counts.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return with_prf(sums)


def event_counts_by_action(truth: DataFrame, pred: DataFrame, kinds: DataFrame, clip: list[str]) -> DataFrame:
    """tp, fp, fn per action from matched kinds; a match counts for the truth action even if the actions differ."""
    def part(df: DataFrame, action: Column, n: Column, **flags) -> DataFrame:
        cols = {c: n if c in flags else F.lit(0).cast("bigint") for c in ("gt", "pred", "hit_gt", "hit_pred")}
        return df.select(action.alias("action"), *[c.alias(k) for k, c in cols.items()])

    one = F.lit(1).cast("bigint")
    rows = (
        part(truth, F.col("action"), one, gt=True)
        .unionByName(part(pred, F.col("action"), one, pred=True))
        .unionByName(part(kinds, F.col("gt.action"), F.col("n"), hit_gt=True))
        .unionByName(part(kinds, F.col("pred.action"), F.col("n"), hit_pred=True))
    )
    sums = rows.groupBy("action").agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "hit_gt", "hit_pred")])
    return sums.select(
        "action", F.col("hit_gt").alias("tp"),
        (F.col("pred") - F.col("hit_pred")).alias("fp"), (F.col("gt") - F.col("hit_gt")).alias("fn"),
    )


def matched_accuracy(kinds: DataFrame) -> DataFrame:
    """Action, agent-category and target-category accuracy over matched events (0 without any)."""
    def share(field: str) -> Column:
        hits = F.sum(F.when(F.col(f"gt.{field}") == F.col(f"pred.{field}"), F.col("n")).otherwise(0))
        return F.coalesce(F.try_divide(hits, F.sum("n")), F.lit(0.0))

    return kinds.agg(
        share("action").alias("action_accuracy"),
        share("agent_category").alias("agent_accuracy"),
        share("target_category").alias("target_accuracy"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_matched"),
    )


def attribute_accuracy(pairs: DataFrame, truth: str, pred: str, axes: list[str] = AXES) -> DataFrame:
    """Share of equal values per axis over matched objects where either side has a value."""
    axis = F.explode(F.array(*map(F.lit, axes))).alias("axis")
    long = pairs.select(truth, pred, axis).select(
        "axis", F.element_at(truth, F.col("axis")).alias("_a"), F.element_at(pred, F.col("axis")).alias("_b")
    )
    used = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    equal = used & F.col("_a").eqNullSafe(F.col("_b"))
    counted = long.groupBy("axis").agg(F.count_if(equal).alias("n_correct"), F.count_if(used).alias("n_total"))
    return counted.withColumn("accuracy", F.coalesce(F.try_divide("n_correct", "n_total"), F.lit(0.0)))


def clip_counts(clips: DataFrame, truth: DataFrame, pred: DataFrame, clip: list[str]) -> DataFrame:
    """Truth and predicted events per clip, zeros included."""
    g = truth.groupBy(*clip).agg(F.count(F.lit(1)).alias("gt_events"))
    p = pred.groupBy(*clip).agg(F.count(F.lit(1)).alias("pred_events"))
    out = clips.join(g, clip, "left").join(p, clip, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("gt_events", "pred_events")})


def false_positive_report(counts: DataFrame) -> DataFrame:
    """Clips without truth events: how many, how many with predicted events, how many such events."""
    empty = F.col("gt_events") == 0
    return counts.agg(
        F.count_if(empty).alias("no_event_clips_total"),
        F.count_if(empty & (F.col("pred_events") > 0)).alias("no_event_clips_with_pred_events"),
        F.coalesce(F.sum(F.when(empty, F.col("pred_events"))), F.lit(0)).cast("bigint").alias("total_spurious_events"),
    )


def action_lists(events: DataFrame, clip: list[str], order: str, out: str) -> DataFrame:
    """All actions of each clip in order, one row a clip."""
    listed = events.groupBy(*clip).agg(F.sort_array(F.collect_list(F.struct(order, "action"))).alias("_l"))
    return listed.select(*clip, F.transform("_l", lambda x: x["action"]).alias(out))


def quality_report(truth: DataFrame, pred: DataFrame, clips: DataFrame, clip: list[str]) -> DataFrame:
    """One row: summary counts, object and event detection, accuracies, false positives, per-name tables."""
    kinds = settle(match.match_event_kinds(truth, pred, clip))  # five parts read it; it is solved once
    objects = object_counts(truth, pred, clip, "target_category")
    actions = event_counts_by_action(truth, pred, kinds, clip)
    counts = clip_counts(clips, truth, pred, clip)

    def table(df: DataFrame, key: str, out: str) -> DataFrame:
        # One entry per name of a vocabulary.
        entry = F.struct(key, "tp", "fp", "fn", "precision", "recall", "f1")
        return df.agg(F.sort_array(F.collect_list(entry)).alias(out))

    def detection(df: DataFrame, out: str) -> DataFrame:
        return prf_by(df, []).select(F.struct("precision", "recall", "f1", "tp", "fp", "fn").alias(out))

    summary = counts.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_clips"),
            F.count_if(F.col("gt_events") > 0).alias("n_clips_with_gt_events"),
            F.count_if(F.col("gt_events") == 0).alias("n_clips_no_gt_events"),
        ).alias("summary")
    )
    parts = [
        detection(objects, "object_detection"),
        table(prf_by(objects, ["target_category"]), "target_category", "object_per_category"),
        detection(actions, "event_detection"),
        table(prf_by(actions, ["action"]), "action", "event_per_action"),
        matched_accuracy(kinds).select(F.struct("*").alias("matched_accuracy")),
        false_positive_report(counts).select(F.struct("*").alias("false_positive_analysis")),
    ]
    out = summary
    for p in parts:
        out = out.withColumn(p.columns[0], p.scalar())
    return out
