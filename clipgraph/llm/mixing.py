"""Mixing sources to target weights by a temperature, in DataFrame functions only.

A source with token share p gets a weight proportional to p ** a. The exponent a is bisected so
that the weights reach a target entropy, or so that no source repeats more often than a limit
allows. Weights become token budgets, and each source is dealt out in a hashed order, epoch after
epoch, until its budget is used; a block of the result holds every source by its weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import stored, tag, without, word_count

#: The exponent is a whole number of these steps.
STEPS = 2**20


def source_sizes(df: DataFrame, source: str, tokens: Column) -> DataFrame:
    """One row per source: its tokens, documents, and log of its tokens against the largest source."""
    sizes = df.groupBy(tag(F.col(f"`{source}`")).alias("__s")).agg(
        F.sum(tokens).cast("long").alias("__n"), F.count(F.lit(1)).alias("__docs"))
    return stored(sizes)


def _curve(sizes: DataFrame, largest: int, points: list[int]) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of powers, the entropy, and the most epochs over the fewest."""
    x = F.log(F.col("__n") / F.lit(float(largest)))
    cols = []
    for i, p in enumerate(points):
        power = F.exp(x * F.lit(p / STEPS))
        cols += [F.sum(power).alias(f"z{i}"), F.sum(power * x).alias(f"s{i}"), F.max(F.exp(x * F.lit(p / STEPS - 1.0))).alias(f"r{i}")]
    row = sizes.filter("__n > 0").agg(*cols).first()
    return [(row[f"z{i}"], math.log(row[f"z{i}"]) - p / STEPS * row[f"s{i}"] / row[f"z{i}"], row[f"r{i}"]) for i, p in enumerate(points)]


def _last_true(sizes: DataFrame, largest: int, holds) -> int:
    """Largest exponent, in steps, for which ``holds`` is still true; true at 0 or else 0 is given.

    Bisection, four halvings a pass over the table of sources.
    """
    lo, hi = 0, STEPS
    if holds(*_curve(sizes, largest, [hi])[0]):
        return hi
    while hi - lo > 1:
        step = max(1, (hi - lo) // 16)
        points = list(range(lo + step, hi, step))
        found = [p for p, c in zip(points, _curve(sizes, largest, points), strict=True) if holds(*c)]
        lo, hi = (found[-1], min(found[-1] + step, hi)) if found else (lo, points[0])
    return lo


def exponent(sizes: DataFrame, largest: int, entropy: float, repetition: float) -> tuple[int, float]:
    """Exponent in steps, and the sum of powers there.

    The largest exponent whose entropy reaches ``entropy`` times the log of the number of sources;
    if a source would then have more than ``repetition`` times the epochs of another, the smallest
    exponent that keeps this limit.
    """
    k = sizes.filter("__n > 0").count()
    by_entropy = _last_true(sizes, largest, lambda z, h, r: h >= entropy * math.log(k) - 1e-12)
    over = _last_true(sizes, largest, lambda z, h, r: r > repetition)
    allowed = 0 if _curve(sizes, largest, [0])[0][2] <= repetition else over + 1
    steps = min(STEPS, max(by_entropy, allowed))
    return steps, _curve(sizes, largest, [steps])[0][0]


def mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    entropy: float = 0.95,
    repetition: float = 4.0,
    total: int | None = None,
    blocks: int = 64,
) -> DataFrame:
    """``df`` repeated by source, with tokens, weight, epoch, start_token, block and block_key.

    ``total`` is the number of tokens to hand out. Without it, the total is the least that gives
    every source one whole epoch, so that no document is left out. ``repetition`` bounds the
    epochs of a source against those of the least repeated one. A source's last epoch ends before
    the document that would pass its budget. ``start_token`` counts the tokens dealt out from the
    source before, ``block`` is the part of the mixture the document starts in, and ``block_key``
    is a random order inside a block.

    * Null source: a source of its own. Null or empty text: no tokens, and the document follows
      its place in the order.
    * A source without any tokens: weight 0, one epoch.
    * Repeated rows: each is dealt out on its own. Empty table: no rows.
    * Columns named like a result are replaced.

    A source is summed in up to 4,096 ranges of the order, each shifted by the tokens before it,
    so no task holds a whole source. Text moves once.
    """
    own = ["tokens", "weight", "epoch", "start_token", "block", "block_key"]
    base = without(df, [c for c in own if c not in (key, source, text)]).withColumns({
        "__s": tag(F.col(f"`{source}`")),
        "tokens": word_count(F.col(f"`{text}`")),
        "__m": F.md5(F.concat_ws(":", tag(F.col(f"`{source}`")), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))),
    }).withColumn("__r", F.conv(F.substring("__m", 1, 3), 16, 10).cast("int"))
    sizes = source_sizes(df, source, word_count(F.col(f"`{text}`")))
    largest = sizes.agg(F.max("__n")).first()[0]
    if not largest:
        plan = sizes.select("__s", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("__budget"), "__n")
    else:
        steps, powers = exponent(sizes, largest, entropy, repetition)
        power = F.when(F.col("__n") > 0, F.exp(F.log(F.col("__n") / F.lit(float(largest))) * F.lit(steps / STEPS))).otherwise(0.0)
        scale = F.lit(float(largest)) if total is None else F.lit(total / powers)
        budget = F.floor(power * scale + F.lit(1e-6)).cast("long")
        plan = sizes.select("__s", (power / F.lit(powers)).alias("weight"), budget.alias("__budget"), "__n")
    plan = plan.withColumns({
        "__full": F.when(F.col("__n") > 0, F.expr("__budget div __n")).otherwise(F.lit(1).cast("long")),
        "__rest": F.when(F.col("__n") > 0, F.expr("__budget % __n")).otherwise(F.lit(0).cast("long")),
    })
    spans = base.groupBy("__s", "__r").agg(F.sum("tokens").alias("__t"))
    before = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    shifts = spans.select("__s", "__r", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__shift")).join(plan, "__s")
    inside = Window.partitionBy("__s", "__r").orderBy("__m", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = base.withColumn("__in", F.sum("tokens").over(inside)).join(shifts, ["__s", "__r"]).withColumn(
        "__end", F.col("__in") + F.col("__shift"))
    last = F.when(F.col("__end") <= F.col("__rest"), F.col("__full")).otherwise(F.col("__full") - 1)
    dealt = dealt.withColumn("epoch", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)))).withColumn(
        "start_token", F.col("epoch") * F.col("__n") + F.col("__end") - F.col("tokens"))
    block = F.when(F.col("__budget") > 0, F.least(F.lit(blocks - 1), F.expr(f"(start_token * {blocks}) div __budget"))).otherwise(0)
    dealt = dealt.withColumn("block", block.cast("int")).withColumn(
        "block_key", F.md5(F.concat_ws(":", F.col("block").cast("string"), F.col("epoch").cast("string"), F.col("__m"))))
    return dealt.drop("__s", "__m", "__r", "__in", "__shift", "__n", "__budget", "__full", "__rest", "__end")
