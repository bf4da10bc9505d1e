"""Analytics over slot attention ``(sample_id, slot, t, y, x, w)`` and slot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipgraph.functions import arrays

_CELL = ["y", "x"]
_TOKEN = ["sample_id", "t", "y", "x"]


def spatial_map(attn: DataFrame) -> DataFrame:
    """Attention mass per sample, slot and grid cell."""
    return attn.groupBy("sample_id", "slot", *_CELL).agg(F.sum("w").alias("w"))


def group_softmax(df: DataFrame, group: list[str], logit: str, out: str = "w") -> DataFrame:
    """Softmax of ``logit`` within each group.

    A group is the slots of one token or the classes of one query, so its size is a constant
    of the model.
    """
    over = Window.partitionBy(*group)
    shifted = F.exp(F.col(logit) - F.max(logit).over(over))
    return df.withColumn("_z", shifted).withColumn(out, F.col("_z") / F.sum("_z").over(over)).drop("_z")


def slot_ownership(attn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winning slot per token, and the most frequent winner per cell (smallest on ties)."""
    won = attn.groupBy(*_TOKEN).agg(F.max_by(F.col("slot"), F.struct("w", -F.col("slot"))).alias("slot"))
    votes = won.groupBy("sample_id", *_CELL, "slot").agg(F.count(F.lit(1)).alias("_n"))
    owner = votes.groupBy("sample_id", *_CELL).agg(F.max_by(F.col("slot"), F.struct("_n", -F.col("slot"))).alias("owner"))
    return won, owner


def temporal_profile(attn: DataFrame) -> DataFrame:
    """Mean and population deviation over samples of the mass per slot and time."""
    mass = attn.groupBy("sample_id", "slot", "t").agg(F.sum("w").alias("_m"))
    return mass.groupBy("slot", "t").agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std"))


def _entropy(p: Column) -> Column:
    return -F.sum(p * F.log(p + F.lit(1e-10)))


def spatial_entropy(attn: DataFrame) -> DataFrame:
    """Entropy of each slot's spatial map per sample."""
    mass = spatial_map(attn)
    total = mass.groupBy("sample_id", "slot").agg(F.sum("w").alias("_s"))
    p = F.col("w") / (F.col("_s") + F.lit(1e-10))
    return mass.join(total, ["sample_id", "slot"]).groupBy("sample_id", "slot").agg(_entropy(p).alias("entropy"))


def slot_entropy(attn: DataFrame, cells: int) -> DataFrame:
    """Mean and sample deviation of the spatial entropy per slot, with its maximum ln(cells)."""
    return spatial_entropy(attn).groupBy("slot").agg(
        F.avg("entropy").alias("mean"), F.stddev_samp("entropy").alias("std"), F.log(F.lit(float(cells))).alias("max_entropy")
    )


def token_entropy(attn: DataFrame) -> DataFrame:
    """Entropy across slots of each token."""
    return attn.groupBy(*_TOKEN).agg(_entropy(F.col("w")).alias("entropy"))


def ranked_extremes(df: DataFrame, value: str, tie: list[str], n: int) -> DataFrame:
    """The ``n`` smallest and ``n`` largest rows; each side keeps a bounded heap per task."""
    low = df.orderBy(F.col(value).asc(), *tie).limit(n).withColumn("side", F.lit("low"))
    high = df.orderBy(F.col(value).desc(), *tie).limit(n).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def top_slots(slots: DataFrame, k: int) -> DataFrame:
    """The ``k`` slots of highest existence per sample."""
    over = Window.partitionBy("sample_id").orderBy(F.col("existence").desc(), "slot")
    return slots.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def active_slots(slots: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Number of active slots per sample."""
    return slots.groupBy("sample_id").agg(F.count_if(F.col("existence") > threshold).alias("n_active"))


def active_summary(slots: DataFrame) -> DataFrame:
    return active_slots(slots).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("n_active").alias("mean"),
        F.min("n_active").alias("min"), F.max("n_active").alias("max"),
    )


def active_categories(slots: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predicted categories of active slots."""
    active = slots.where(F.col("existence") > threshold)
    return active.groupBy(arrays.argmax(F.col("cat_logits")).alias("category_id")).agg(F.count(F.lit(1)).alias("n"))


def unit_maps(attn: DataFrame) -> DataFrame:
    """Spatial maps scaled to length 1 per sample and slot."""
    mass = spatial_map(attn)
    norm = mass.groupBy("sample_id", "slot").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return mass.join(norm, ["sample_id", "slot"]).withColumn("w", F.col("w") / F.greatest("_n", F.lit(1e-12))).drop("_n")


def slot_consistency(attn: DataFrame) -> DataFrame:
    """Mean cosine of each slot's map over all pairs of samples.

    The sum over pairs is (|sum of vectors|^2 - sum of |vector|^2) / 2, so no pair is formed.
    """
    cells = unit_maps(attn).groupBy("slot", *_CELL).agg(
        F.sum("w").alias("_v"), F.sum(F.col("w") * F.col("w")).alias("_q"), F.count(F.lit(1)).alias("_n")
    )
    per = cells.groupBy("slot").agg(
        ((F.sum(F.col("_v") * F.col("_v")) - F.sum("_q")) / 2).alias("_pairs"), F.max("_n").alias("n_samples")
    )
    n = F.col("n_samples")
    return per.select("slot", "n_samples", (F.col("_pairs") / F.greatest(n * (n - 1) / 2, F.lit(1.0))).alias("consistency"))


def slot_similarity(attn: DataFrame) -> DataFrame:
    """Dot products of the mean unit maps of every two slots (slots x slots x cells rows at most)."""
    mean = unit_maps(attn).groupBy("slot", *_CELL).agg(F.avg("w").alias("w"))
    a = mean.select(F.col("slot").alias("slot_a"), *_CELL, F.col("w").alias("_a"))
    b = mean.select(F.col("slot").alias("slot_b"), *_CELL, F.col("w").alias("_b"))
    return a.join(b, _CELL).groupBy("slot_a", "slot_b").agg(F.sum(F.col("_a") * F.col("_b")).alias("similarity"))


def weighted_pooling(attn: DataFrame, tokens: DataFrame, token_key: list[str], vec: str, dim: int, group: list[str]) -> DataFrame:
    """Attention-weighted mean of token vectors per group: sum(w*x) / (sum(w) + 1e-8)."""
    # The vectors move as they are, once a row; products would be twice as wide and hardly fewer.
    joined = attn.join(tokens.select(*token_key, vec), token_key).select(*group, "w", vec).repartition(*group)
    sums = arrays.vector_aggregate(joined, group, vec, dim, lambda x: F.sum(F.col("w") * x), "_sums", _w=F.sum("w"))
    weight = F.col("_w") + F.lit(1e-8)
    return sums.withColumn("_w", weight).select(*group, F.transform("_sums", lambda s: s / F.col("_w")).alias("pooled"))
