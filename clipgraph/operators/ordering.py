"""Exact positions and running sums in a total order, without a single hot task.

A window over the whole table (or over a key that holds much of it) runs in one task.
Here the rows are first cut into ranges of about equal size along the full ordering key,
taken from a bounded deterministic sample. Each range is ranked on its own and shifted by
the totals of the ranges before it. The cut points are literals in the plan, so a task
that is run again after a lost executor gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_BUCKET = "_bucket"
_SAMPLES_PER_BUCKET = 16
_SMALL_BYTES = 64 << 20
_COUNTED_BYTES = 1 << 20
_SORTED_BYTES = 128 << 20

_MOST_LEVELS = 14
#: Plan nodes after which the optimizer's estimate says nothing: they can make any number of rows from one.
_GROWING = ("Generate ", "MapInPandas", "MapInArrow", "FlatMapGroups", "LogicalRDD")


def _row_bytes(df: DataFrame) -> int:
    """Bytes of a row while it is sorted: its slots, text of common length, and what points to it."""
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return 40 + sum(32 if isinstance(f.dataType, wide) else 8 for f in df.schema.fields)


def _small(df: DataFrame) -> bool:
    """Whether one task can hold the input: the optimizer's estimate says so, can be trusted, and the rows agree.

    The estimate counts the bytes of compressed files, of which rows can take thirty times as much; so from
    1 MB on the rows are counted, which takes no more than the footers of the files where only they are read.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(node in plan.toString() for node in _GROWING):
        return False
    estimate = int(plan.stats().sizeInBytes())
    if estimate <= _COUNTED_BYTES or estimate > _SMALL_BYTES:
        return estimate <= _COUNTED_BYTES
    return df.count() * _row_bytes(df) <= _SORTED_BYTES


def _levels(df: DataFrame, buckets: int | None) -> int:
    wanted = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(_MOST_LEVELS, max(4, math.ceil(math.log2(max(2, wanted)))))


def _sample(df: DataFrame, keys: list[Column], size: int) -> list[str]:
    """At most ``size`` key tuples as JSON, picked by hash and sorted by key."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    picked = df.select(*named).orderBy(F.xxhash64(*names), *names).limit(size)
    rows = picked.orderBy(*names).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).collect()
    return [r[0] for r in rows]


def _count_below(key: Column, cuts: list[Column], lo: int, hi: int) -> Column:
    """Number of ``cuts[:hi]`` at or below ``key``, given that ``cuts[:lo]`` are."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(cuts[mid] <= key, _count_below(key, cuts, mid + 1, hi)).otherwise(_count_below(key, cuts, lo, mid))


_TREE_LEVELS = 5


def _bucket_of(key: Column, picks: list[str], kind: T.StructType, levels: int) -> Column:
    """Number of cut points at or below ``key``: a binary search of ``levels`` steps.

    The first steps are a tree of comparisons in generated code; a tree of all cut points
    would outgrow a method, so further steps look into an array.
    """
    rest = max(0, levels - _TREE_LEVELS)
    coarse = [F.from_json(F.lit(p), kind) for p in picks[(1 << rest) - 1 :: 1 << rest]]
    at = _count_below(key, coarse, 0, len(coarse)) * (1 << rest)
    if not rest:
        return at
    bounds = F.from_json(F.lit("[" + ",".join(picks) + "]"), T.ArrayType(kind))
    steps = F.array(*[F.lit(1 << (rest - 1 - i)) for i in range(rest)])
    return F.aggregate(
        steps, at, lambda acc, step: F.when(F.get(bounds, acc + step - 1) <= key, acc + step).otherwise(acc)
    )


def prefix_sums(
    df: DataFrame,
    order_by: list[str],
    sums: dict[str, Column],
    partition_by: list[str] = (),
    lags: dict[str, str] | None = None,
    buckets: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` in ascending ``order_by``, per ``partition_by``.

    ``order_by`` together with ``partition_by`` must be unique. ``lags`` maps a new column to
    the column whose previous value it holds. ``split`` forces (or forbids) the range-cut
    plan; by default a plain window serves inputs of at most 64 MB by the optimizer's
    estimate (not taken where rows are exploded or made in Python) whose rows take at most
    128 MB in a sort, inputs smaller than the sample, and keyed inputs whose sample shows no key too large for one task.
    """
    lags = lags or {}
    parts = list(partition_by)
    if split is None and _small(df):
        split = False
    levels = _levels(df, buckets)
    count = 1 << levels
    keys = [F.col(c) for c in (*parts, *order_by)]
    sample: list[str] = []
    if split is not False:
        sample = _sample(df, keys, count * _SAMPLES_PER_BUCKET)
        full = len(sample) >= count * _SAMPLES_PER_BUCKET
        if split is None and not full:
            split = False
        elif split is None:
            split = _hottest_share(sample, len(parts)) > 2.0 / count if parts else True
    if not split or not sample:
        return _plain(df, order_by, sums, parts, lags)

    picks = [sample[min(len(sample) - 1, (i + 1) * len(sample) // count)] for i in range(count - 1)]
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate((*parts, *order_by))]
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    cut = df.withColumn(_BUCKET, _bucket_of(key, picks, T.StructType(fields), levels))

    order = F.struct(*order_by)
    totals = cut.groupBy(*parts, _BUCKET).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max_by(F.col(c), order).alias(n) for n, c in lags.items()],
        F.lit(1).alias("_one"),
    )
    along = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(_BUCKET)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(p).alias(f"_p{i}") for i, p in enumerate(parts)],
        F.col(_BUCKET).alias("_b"),
        F.sum("_one").over(before).alias("_before"),
        *[F.sum(n).over(before).alias(f"_off_{n}") for n in sums],
        *[F.lag(n).over(along).alias(f"_off_{n}") for n in lags],
    ).where("_before > 0")
    # Only the first partition of a range can continue from an earlier range, so there is at
    # most one offset row per range (16,384 at the very most): small enough to broadcast.
    on = F.col(_BUCKET) == F.col("_b")
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    joined = cut.join(F.broadcast(offsets), on, "left")
    within = Window.partitionBy(*parts, _BUCKET).orderBy(*order_by)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(within) == 1
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(upto) + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n, c in sums.items()],
        *[F.when(first, F.col(f"_off_{n}")).otherwise(F.lag(c).over(within)).alias(n) for n, c in lags.items()],
    )


def _hottest_share(sample: list[str], n_parts: int) -> float:
    import json
    from collections import Counter

    counted = Counter(tuple(str(json.loads(s)[f"k{i}"]) for i in range(n_parts)) for s in sample)
    return counted.most_common(1)[0][1] / len(sample)


def _plain(df, order_by, sums, parts, lags) -> DataFrame:
    within = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(*order_by)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        *df.columns,
        *[F.sum(c).over(upto).alias(n) for n, c in sums.items()],
        *[F.lag(c).over(within).alias(n) for n, c in lags.items()],
    )


def row_index(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] = (),
    name: str = "row_index",
    buckets: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Dense 0-based position (BIGINT) of each row in ``order_by``, per ``partition_by``."""
    counted = prefix_sums(df, order_by, {name: F.lit(1).cast("bigint")}, partition_by, None, buckets, split)
    return counted.withColumn(name, F.col(name) - 1)


def batch_index(df: DataFrame, order_by: list[str], size: int, drop_last: bool = False) -> DataFrame:
    """Add ``batch_index`` and ``batch_pos`` for consecutive batches of ``size`` rows."""
    at = row_index(df, order_by, name="_at")
    out = at.withColumn("batch_index", F.floor(F.col("_at") / size)).withColumn("batch_pos", F.col("_at") % size)
    if drop_last:
        whole = df.agg(F.floor(F.count(F.lit(1)) / size)).scalar()
        out = out.where(F.col("batch_index") < whole)
    return out.drop("_at")


def seeded_split(
    df: DataFrame,
    id_col: str,
    seed: int = 42,
    train: float | None = 0.8,
    val: float = 0.1,
    test: float | None = None,
) -> DataFrame:
    """Add ``split``: exact sizes over a seeded md5 shuffle of ``id_col``.

    With ``train`` given: train = floor(train*n), val = floor(val*n), test the rest, taken in
    the order train, val, test. With ``train=None``: test and val are floor(val*n) each and
    train is the rest.
    """
    shuffled = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))))
    at = row_index(shuffled, ["_h", id_col], name="_at")
    at = at.withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    held = F.floor(F.col("_n") * F.lit(val))
    n_train = F.floor(F.col("_n") * F.lit(train)) if train is not None else F.col("_n") - 2 * held
    named = (
        F.when(F.col("_at") < n_train, "train").when(F.col("_at") < n_train + held, "val").otherwise("test")
    )
    return (
        at.withColumn("split", named)
        .withColumn("split_pos", F.col("_at"))
        .drop("_h", "_at", "_n")
    )
