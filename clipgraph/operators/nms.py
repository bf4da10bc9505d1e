"""Suppression of duplicate events by confidence within a frame distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROUNDS = 2


def suppress_duplicates(
    events: DataFrame,
    keys: list[str],
    frame: str = "frame",
    confidence: str = "confidence",
    tie: str = "event_seq",
    distance: int = 3,
) -> DataFrame:
    """Keep an event unless a kept one of the same keys is within ``distance`` frames.

    Events are taken by falling confidence, then rising ``tie``. Exact at any skew:

    1. Only the best event of each (keys, frame) can be kept, since the rest lie at distance
       0 from it. That is a partial aggregate, so a key with very many rows shrinks before
       the shuffle to at most one row per frame of its video.
    2. An event that is the best within ``distance`` is kept and its neighbours go. Twice
       over the same sorted partitions, with no new shuffle.
    3. What is still open is cut at the kept events: two rows on different sides of one are
       further apart than ``distance``. Each piece is gone through once, by falling rank.
    """
    rank = F.struct(F.col(confidence).alias("c"), (-F.col(tie)).alias("t"))
    rest = [c for c in events.columns if c not in (*keys, frame)]
    best = events.groupBy(*keys, frame).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    rows = best.select(
        *keys,
        frame,
        "_row",
        F.struct(F.col(f"_row.{confidence}").alias("c"), (-F.col(f"_row.{tie}")).alias("t")).alias("_rank"),
        F.lit(None).cast("boolean").alias("_kept"),
    )
    along = Window.partitionBy(*keys).orderBy(frame)
    near = along.rangeBetween(-distance, distance)
    for _ in range(_ROUNDS):
        is_open = F.col("_kept").isNull()
        rows = rows.withColumn("_top", F.max(F.when(is_open, F.col("_rank"))).over(near))
        rows = rows.withColumn("_peak", is_open & (F.col("_rank") == F.col("_top")))
        rows = rows.withColumn("_hit", F.max("_peak").over(near))
        decided = F.when(F.col("_kept").isNull() & F.col("_hit"), F.col("_peak")).otherwise(F.col("_kept"))
        rows = rows.withColumn("_kept", decided)
    rows = rows.withColumn("_piece", F.count_if(F.coalesce("_kept", F.lit(False))).over(along))

    sure = rows.where("_kept").select(*keys, frame, "_row")
    left = rows.where(F.col("_kept").isNull()).select(*keys, "_piece", frame, F.col("_rank.c").alias("_c"), F.col("_rank.t").alias("_t"), "_row")
    out = sure.unionByName(_settle_pieces(left, [*keys, "_piece"], frame, distance).select(*keys, frame, "_row"))
    return out.select(*keys, frame, "_row.*").select(*events.columns)


def pick(frames: np.ndarray, order: np.ndarray, distance: int) -> np.ndarray:
    """Which of the frames stay when they are taken in ``order`` and each shuts out those within ``distance``."""
    kept: set[int] = set()
    stay = np.zeros(len(frames), bool)
    for i, f in zip(order.tolist(), frames[order].tolist(), strict=True):
        if kept.isdisjoint(range(f - distance, f + distance + 1)):
            kept.add(f)
            stay[i] = True
    return stay


def _settle_pieces(rows: DataFrame, group: list[str], frame: str, distance: int) -> DataFrame:
    """Rows that stay of each piece, in time n log n of its rows, one for each frame at most.

    A long run of rising confidence is one piece, since only its end is the best around. Other columns pass through as
    they are, in Arrow batches; a task holds one piece and one batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            starts = _starts(held, group)
            if len(starts) > 1:
                yield from _stay(held.slice(0, int(starts[-1])), starts[:-1], frame, distance)
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield from _stay(held, _starts(held, group), frame, distance)

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, rows.schema)


def _starts(table: pa.Table, group: list[str]) -> np.ndarray:
    """First row of each group in sorted rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in group:
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _stay(table: pa.Table, starts: np.ndarray, frame: str, distance: int) -> Iterator[pa.RecordBatch]:
    frames, c, t = (table.column(n).to_numpy() for n in (frame, "_c", "_t"))
    stay = np.zeros(table.num_rows, bool)
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
        part = slice(begin, end)
        stay[part] = pick(frames[part], np.lexsort((-t[part], -c[part])), distance)
    yield from table.filter(pa.array(stay)).to_batches()
