"""Expressions on numeric arrays: argmax, softmax, padding, masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(a: Column) -> Column:
    """0-based position of the maximum, the first on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a).cast("double")
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)))


def log_softmax_at(a: Column, index: Column) -> Column:
    """log softmax(a)[index] for a 0-based index."""
    return F.get(a, index).cast("double") - log_sum_exp(a)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pad_to(a: Column, size: int, fill: Column) -> Column:
    """The first ``size`` items, filled up at the end."""
    return F.slice(F.concat(a, F.array_repeat(fill, size)), 1, size)


def valid_mask(n: Column, size: int) -> Column:
    """``size`` booleans, true for the first ``n``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < n)


def mask_logits(logits: Column, mask: Column, none_slot: bool = False) -> Column:
    """Logits of invalid objects become -inf; a trailing "none" slot always stays valid."""
    full = F.concat(mask, F.array(F.lit(True))) if none_slot else mask
    low = F.lit(float("-inf"))
    return F.zip_with(logits, full, lambda x, keep: F.when(keep, x.cast("double")).otherwise(low))


def csv(a: Column) -> Column:
    """Array as comma-separated text (null items are kept as ``null``)."""
    return F.array_join(a.cast("array<string>"), ",", "null")


#: Dimensions that one row of a vector aggregate holds.
VECTOR_BLOCK = 16


def vector_aggregate(
    rows: DataFrame, keys: list[str], vec: str, dim: int, item: Callable[[Column], Column], name: str, **others: Column,
) -> DataFrame:
    """(keys, name, others): the aggregate ``item`` of each of the first ``dim`` dimensions per key.

    A row is taken apart into blocks of ``VECTOR_BLOCK`` dimensions inside one generated loop, so an
    aggregate has that many buffers whatever the width; only sums of blocks cross the shuffle, and no
    vector is collected. ``others`` are further aggregates of the rows of a key. Dimensions that a
    vector lacks are null for ``item``.
    """
    blocks = -(-dim // VECTOR_BLOCK)
    cut = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    values = [F.get(F.col(vec), F.col("_b") * VECTOR_BLOCK + i).cast("double") for i in range(VECTOR_BLOCK)]
    sums = cut.groupBy(*keys, "_b").agg(*[item(x).alias(f"_v{i}") for i, x in enumerate(values)], *[c.alias(n) for n, c in others.items()])
    entry = F.struct("_b", F.array(*[f"_v{i}" for i in range(VECTOR_BLOCK)]).alias("v"))
    whole = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_all"), *[F.first(n).alias(n) for n in others])
    return whole.select(*keys, F.slice(F.flatten(F.transform("_all", lambda x: x["v"])), 1, dim).alias(name), *others)
