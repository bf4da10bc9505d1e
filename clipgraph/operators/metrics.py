"""Evaluation metrics over prediction and truth tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays
from clipgraph.operators import match
from clipgraph.operators.decode import active_queries, argmax_heads
from clipgraph.operators.ordering import prefix_sums, row_index
from clipgraph.session import settle


def accuracy(df: DataFrame, logits: str, target: str) -> DataFrame:
    """Share of rows whose largest logit is at the target."""
    hit = (arrays.argmax(F.col(logits)) == F.col(target)).cast("double")
    return df.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def average_precision(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Area under precision * label over recall by the trapezoid rule, by falling score then ``tie``.

    Needs the rank, the running number of positives and the label before each row; all three
    come from one range-cut prefix pass. A step in recall occurs only at a positive.
    """
    rows = df.select((-F.col(score)).alias("_neg"), F.col(tie).alias("_tie"), F.col(label).cast("double").alias("_y"))
    ranked = prefix_sums(
        rows, ["_neg", "_tie"], {"_rank": F.lit(1.0), "_tp": F.col("_y")}, lags={"_before": "_y"}
    )
    eps = F.lit(1e-8)
    here = F.col("_tp") / (F.col("_rank") + eps)
    prev = F.when(
        F.col("_before") > 0, (F.col("_tp") - F.col("_y")) / (F.col("_rank") - 1 + eps)
    ).otherwise(F.lit(0.0))
    # The first row opens the curve and has no interval before it.
    area = F.when((F.col("_y") > 0) & (F.col("_rank") > 1), (here + prev) / 2).otherwise(F.lit(0.0))
    return ranked.agg(
        F.coalesce(F.sum(area) / (F.sum("_y") + eps), F.lit(0.0)).alias("average_precision")
    )


def active_predictions(pred: DataFrame, key: str = "sample_id") -> DataFrame:
    """Active queries (score above 0.5) with their decoded heads and position in the corpus."""
    active = argmax_heads(active_queries(pred, 0.5, strict=True))
    placed = row_index(active, [key, "q"], name="pos")
    return placed.select(
        key, "q", "pos", F.col("action").alias("action_class"), F.col("agent_ptr").alias("agent_track_id"),
        F.col("target_ptr").alias("target_track_id"), F.col("frame").alias("event_frame_index"),
    )


def placed_truth(truth: DataFrame, key: str = "sample_id", ident: str = "gt_id") -> DataFrame:
    return row_index(truth, [key, ident], name="pos")


HEADS = ["action_class", "agent_track_id", "target_track_id", "event_frame_index"]


def positional_pairs(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """The i-th active prediction beside the i-th truth, cut to the shorter side."""
    a = active_predictions(pred).select("pos", *[F.col(c).alias(f"pred_{c}") for c in HEADS])
    b = placed_truth(truth).select("pos", *[F.col(c).alias(f"gt_{c}") for c in HEADS])
    return a.join(b, "pos")


def matched_pairs(pred: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions beside the truth they are assigned to (the corrected pairing)."""
    pairs = match.match_queries(pred, truth, key)
    heads = argmax_heads(pred).select(
        key, "q", F.col("action").alias("pred_action_class"), F.col("agent_ptr").alias("pred_agent_track_id"),
        F.col("target_ptr").alias("pred_target_track_id"), F.col("frame").alias("pred_event_frame_index"),
    )
    gts = truth.select(key, "gt_id", *[F.col(c).alias(f"gt_{c}") for c in HEADS])
    return pairs.join(heads, [key, "q"]).join(gts, [key, "gt_id"])


def _pairs(pred: DataFrame, truth: DataFrame, pairing: str) -> DataFrame:
    if pairing == "positional":
        return positional_pairs(pred, truth)
    if pairing == "matched":
        return matched_pairs(pred, truth)
    raise ValueError("pairing must be positional or matched")


def _same(c: str) -> Column:
    return (F.col(f"pred_{c}") == F.col(f"gt_{c}")).cast("double")


#: Metrics that are one aggregate over pairs of a prediction and a truth.
PAIR_METRICS: dict[str, Callable[[], Column]] = {
    "action_accuracy": lambda: F.avg(_same("action_class")),
    # agent and target pointers pooled
    "pointer_accuracy": lambda: F.sum(_same("agent_track_id") + _same("target_track_id")) / F.greatest(2 * F.count(F.lit(1)), F.lit(1)),
    "frame_mae": lambda: F.avg(F.abs(F.col("pred_event_frame_index") - F.col("gt_event_frame_index"))),
}


def pair_metrics(pred: DataFrame, truth: DataFrame, names: list[str], pairing: str = "positional") -> DataFrame:
    """One row with the named metrics, all from one pass over the pairs (0 without any)."""
    return _pairs(pred, truth, pairing).agg(*[F.coalesce(PAIR_METRICS[n](), F.lit(0.0)).alias(n) for n in names])


def action_accuracy(pred: DataFrame, truth: DataFrame, pairing: str = "positional") -> DataFrame:
    return pair_metrics(pred, truth, ["action_accuracy"], pairing)


def pointer_accuracy(pred: DataFrame, truth: DataFrame, pairing: str = "positional") -> DataFrame:
    """Agent and target pointers pooled."""
    return pair_metrics(pred, truth, ["pointer_accuracy"], pairing)


def frame_mae(pred: DataFrame, truth: DataFrame, pairing: str = "positional") -> DataFrame:
    return pair_metrics(pred, truth, ["frame_mae"], pairing)


def graph_f1(pred: DataFrame, truth: DataFrame, edge: list[str], scope: list[str] = ()) -> DataFrame:
    """F1 of the distinct edge tuples; with a ``scope`` the tuples also carry those columns.

    Both sides are tagged and reduced in one aggregate instead of two distincts and an
    intersection.
    """
    cols = [*scope, *edge]
    tagged = pred.select(*cols, F.lit(1).alias("_p"), F.lit(0).alias("_g")).unionByName(
        truth.select(*cols, F.lit(0).alias("_p"), F.lit(1).alias("_g"))
    )
    found = tagged.groupBy(*cols).agg(F.max("_p").alias("_p"), F.max("_g").alias("_g"))
    n = found.agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.sum("_g"), F.lit(0)).alias("n_gt"),
        F.count_if((F.col("_p") == 1) & (F.col("_g") == 1)).alias("tp"),
    )
    p, r = F.try_divide("tp", "n_pred"), F.try_divide("tp", "n_gt")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return n.select("n_pred", "n_gt", "tp", F.when((F.col("n_pred") == 0) & (F.col("n_gt") == 0), F.lit(1.0)).otherwise(f1).alias("graph_f1"))


def detection_labels(pred: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Score and label per query: 1 for queries the assignment matched to a truth."""
    hit = match.match_queries(pred, truth, key).select(key, "q", F.lit(1.0).alias("label"))
    scored = pred.select(key, "q", arrays.sigmoid(F.col("interaction")).alias("score"))
    return scored.join(hit, [key, "q"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def metric_inputs(pred: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Aligned lists in long form: ``side``, ``pos`` and the four decoded values."""
    a = active_predictions(pred, key).select(F.lit("pred").alias("side"), "pos", *HEADS)
    b = placed_truth(truth, key).select(F.lit("gt").alias("side"), "pos", *HEADS)
    return a.unionByName(b)


Metric = Callable[[DataFrame, DataFrame], DataFrame]


def _event_detection_map(pred: DataFrame, truth: DataFrame) -> DataFrame:
    labels = detection_labels(pred, truth).withColumn("_id", F.format_string("%012d|%06d", "sample_id", "q"))
    return average_precision(labels, "score", "label", "_id")


def _graph_f1(pred: DataFrame, truth: DataFrame) -> DataFrame:
    active = argmax_heads(active_queries(pred, 0.5, strict=True)).select(
        F.col("agent_ptr").alias("agent_track_id"), F.col("action").alias("action_class"),
        F.col("target_ptr").alias("target_track_id"),
    )
    return graph_f1(active, truth, ["agent_track_id", "action_class", "target_track_id"]).select("graph_f1")


METRICS: dict[str, Metric] = {
    "event_detection_map": _event_detection_map,
    "action_accuracy": action_accuracy,
    "pointer_accuracy": pointer_accuracy,
    "frame_mae": frame_mae,
    "graph_f1": _graph_f1,
}


def register_metric(name: str, metric: Metric) -> None:
    """Add a metric: a function of (predictions, truth) that returns one number in one row."""
    METRICS[name] = metric


def metric_suite(pred: DataFrame, truth: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named metrics as rows (metric, value).

    Metrics over positional pairs share one ordering of the corpus and one pass; the others are planned one by one.
    """
    names = list(METRICS) if names is None else names
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known are {sorted(METRICS)}")
    own = {"action_accuracy": action_accuracy, "pointer_accuracy": pointer_accuracy, "frame_mae": frame_mae}
    paired = [n for n in dict.fromkeys(names) if METRICS[n] is own.get(n)]
    out = None
    if paired:
        row = pair_metrics(pred, truth, paired)
        entries = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in paired]))
        out = row.select(entries.alias("_m")).select("_m.metric", "_m.value")
    for n in names:
        if n in paired:
            continue
        one = METRICS[n](pred, truth)
        row = one.select(F.lit(n).alias("metric"), F.col(one.columns[0]).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


# Default weights of the heads in the total.
LOSS_WEIGHTS = {
    "interaction": 2.0, "action": 1.0, "agent_ptr": 1.0, "target_ptr": 1.0, "source_ptr": 0.5, "dest_ptr": 0.5, "frame": 0.5,
}


def _bce_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def _bce(p: Column, y: Column) -> Column:
    log = lambda z: F.greatest(F.log(z), F.lit(-100.0))
    return -(y * log(p) + (1 - y) * log(1 - p))


def scoring_losses(
    pred: DataFrame, truth: DataFrame, key: str = "sample_id", weights: dict[str, float] = LOSS_WEIGHTS,
    matched: DataFrame | None = None,
) -> DataFrame:
    """Log-loss report in one row: interaction over all queries, each head over matched pairs, weighted total.

    The interaction loss is the mean per sample averaged over samples; the head losses are
    divided by the number of matched pairs. A missing source or destination counts as the
    last pointer.
    """
    # two parts read the pairs; they are solved once
    pairs = matched if matched is not None else settle(match.match_queries(pred, truth, key, with_frame=True))
    hit = pairs.select(key, "q", F.lit(1.0).alias("_y"), "gt_id")
    # A sample has a fixed number of queries, so the left join keeps its size.
    tagged = pred.join(hit, [key, "q"], "left")
    bce = _bce_logits(F.col("interaction"), F.coalesce("_y", F.lit(0.0)))
    per_sample = tagged.groupBy(key).agg(F.avg(bce).alias("_l"))
    inter = per_sample.agg(F.coalesce(F.avg("_l"), F.lit(0.0)).alias("interaction"))

    heads = {
        "action": F.col("action_class"), "agent_ptr": F.col("agent_track_id"), "target_ptr": F.col("target_track_id"),
        "source_ptr": F.coalesce("source_track_id", F.size("source_ptr") - 1),
        "dest_ptr": F.coalesce("dest_track_id", F.size("dest_ptr") - 1), "frame": F.col("event_frame_index"),
    }
    both = tagged.where("gt_id is not null").join(truth, [key, "gt_id"])
    losses = both.agg(
        *[F.coalesce(F.avg(-arrays.log_softmax_at(F.col(h), t)), F.lit(0.0)).alias(h) for h, t in heads.items()],
        F.count(F.lit(1)).alias("n_matched"),
    )
    total = sum((F.col(h) * w for h, w in weights.items()), F.lit(0.0))
    return losses.withColumn("interaction", inter.scalar()).withColumn("total", total)


def slot_losses(slots: DataFrame, objects: DataFrame, key: str = "sample_id", matched: DataFrame | None = None) -> DataFrame:
    """Category log loss over matched slots / number of objects, and existence log loss averaged over samples."""
    pairs = matched if matched is not None else match.match_slots(slots, objects, key)
    hit = pairs.join(objects, [key, "obj_idx"]).select(key, "slot", F.col("category_id").alias("_c"))
    tagged = slots.join(hit, [key, "slot"], "left")
    exist = _bce(F.col("existence"), F.col("_c").isNotNull().cast("double"))
    nll = -arrays.log_softmax_at(F.col("cat_logits"), F.col("_c"))
    per = tagged.groupBy(key).agg(F.avg(exist).alias("_e"), F.sum(nll).alias("_s"))
    sums = per.agg(F.avg("_e").alias("existence"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_s"))
    n = objects.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return sums.withColumn("_n", n).select((F.col("_s") / F.col("_n")).alias("category"), "existence")
