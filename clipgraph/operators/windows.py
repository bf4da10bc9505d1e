"""Clip windows over sampled frames, timestamps, coverage and static ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import ids, times
from clipgraph.operators.ordering import row_index

_BLOCK = 4096
_CLIPS_A_PARTITION = 1 << 19


def explode_range(df: DataFrame, n: Column, name: str) -> DataFrame:
    """One row per ``0 .. n-1``; counts up in blocks so no row ever holds a long array."""
    blocks = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(_BLOCK)))
    staged = df.withColumn("_n", n).withColumn("_from", F.explode(blocks))
    upto = F.least(F.col("_from") + _BLOCK - 1, F.col("_n") - 1)
    return staged.withColumn(name, F.explode(F.sequence(F.col("_from"), upto))).drop("_n", "_from")


def dealt_by(df: DataFrame, key: str, n: Column) -> DataFrame:
    """``df`` partitioned by ``key`` for the ``n`` rows that are made of each row: few enough a partition to be sorted in memory."""
    total = df.agg(F.sum(n)).first()[0] or 0
    return df.repartition(max(1, math.ceil(total / _CLIPS_A_PARTITION)), key)


def with_sampling(videos: DataFrame, target_fps: float = 1.0) -> DataFrame:
    """Add ``step`` (source frames per sampled frame) and ``n_sampled``."""
    stepped = videos.withColumn("step", times.frame_step(F.col("source_fps"), target_fps))
    return stepped.withColumn("n_sampled", times.sampled_count(F.col("total_frames"), F.col("step")))


def with_start_time(videos: DataFrame) -> DataFrame:
    """Add ``start_ts`` from the video id."""
    return videos.withColumn("start_ts", times.parse_start_time(F.col("video_id")))


def sample_frames(videos: DataFrame, target_fps: float = 1.0) -> DataFrame:
    """One row per sampled frame: ``frame_index`` and ``timestamp_sec``."""
    rows = explode_range(with_sampling(videos, target_fps), F.col("n_sampled"), "_pos")
    return (
        rows.withColumn("frame_index", F.col("_pos") * F.col("step"))
        .withColumn("timestamp_sec", F.col("frame_index") / F.col("source_fps"))
        .drop("_pos")
    )


def frames_from(start: Column, step: Column, n: int, total: Column) -> Column:
    """``n`` frame numbers from ``start`` at ``step``, those before the end of the video."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * step)
    return F.filter(wanted, lambda f: f < total)


def window_count(n: Column, length: int, stride: int, trailing: str) -> Column:
    """Closed form of the number of windows over ``n`` positions.

    ``keep``: the last window may be short. ``drop``: full windows only. ``at_least_one``:
    full windows, but a short input still gives one.
    """
    spare = F.greatest(F.lit(0), n - length)
    if trailing == "keep":
        return F.least(1 + F.ceil(spare / stride), F.ceil(n / stride)).cast("int")
    if trailing == "drop":
        return F.when(n < length, F.lit(0)).otherwise(F.floor((n - length) / stride) + 1).cast("int")
    if trailing == "at_least_one":
        return F.ceil(F.greatest(F.lit(1), n - length + 1) / stride).cast("int")
    raise ValueError("trailing must be keep, drop or at_least_one")


def clip_windows(
    videos: DataFrame,
    length: int = 16,
    stride: int = 8,
    target_fps: float = 1.0,
    trailing: str = "drop",
    by: str | None = None,
) -> DataFrame:
    """One row per clip with ``clip_index``, ``start_pos`` and ``length`` in sampled frames.

    ``by`` names the video: then the videos are dealt out by it before their clips are made, so
    that a window, join or group over a video moves none of its clips.
    """
    sampled = with_sampling(videos, target_fps)
    n_clips = window_count(F.col("n_sampled"), length, stride, trailing)
    if by:
        sampled = dealt_by(sampled, by, n_clips)
    rows = explode_range(sampled, n_clips, "clip_index")
    start = F.col("clip_index") * stride
    return rows.withColumn("start_pos", start).withColumn("length", F.least(F.lit(length), F.col("n_sampled") - start))


def _steps(first: Column, step: Column, length: Column) -> Column:
    """``length`` numbers from ``first``; a sequence stays in generated code, a lambda would not."""
    rising = F.sequence(first, first + (length - 1) * step, step)
    none = F.array().cast("array<int>")
    return F.when(length <= 0, none).when(step > 0, rising).otherwise(F.array_repeat(first, length))


def clip_frames(start_pos: Column, length: Column, step: Column) -> Column:
    """``frame_indices`` of a clip."""
    return _steps(start_pos * step, step, length)


def with_frame_indices(clips: DataFrame) -> DataFrame:
    return clips.withColumn("frame_indices", clip_frames(F.col("start_pos"), F.col("length"), F.col("step")))


def clip_timestamps(clips: DataFrame) -> DataFrame:
    """Offsets (3 decimals) and ISO times of each clip's first and last frame.

    Needs ``start_ts``, which :func:`with_start_time` adds per video, before the clips are made.
    """
    first = F.col("start_pos") * F.col("step") / F.col("source_fps")
    last = (F.col("start_pos") + F.col("length") - 1) * F.col("step") / F.col("source_fps")
    begin = F.col("start_ts")
    return (
        clips.withColumn("start_offset_sec", F.round(first, 3))
        .withColumn("end_offset_sec", F.round(last, 3))
        .withColumn("start_time", times.offset_to_iso(begin, first))
        .withColumn("end_time", times.offset_to_iso(begin, last))
    )


def clip_membership(df: DataFrame, pos: str, n_clips: Column, length: int = 16, stride: int = 8) -> DataFrame:
    """One row per (row, clip) for rows with a 0-based position; at most ceil(length/stride) copies each."""
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - length + 1) / stride).cast("int"))
    last = F.least(n_clips - 1, F.floor(F.col(pos) / stride).cast("int"))
    return df.withColumn("clip_index", F.explode(F.when(first <= last, F.sequence(first, last))))


def rebuild_frame_indices(clip_index: Column, stride: Column, step: Column, length: Column) -> Column:
    """``[clip_index*stride + j*step]`` for ``j < length``."""
    return _steps(clip_index * stride, step, length)


def token_frames(frame_indices: Column, n_tokens: int) -> Column:
    """Source frame of each two-frame token, the last frame where there is none."""
    ticks = F.sequence(F.lit(0), F.lit(n_tokens - 1))
    return F.transform(ticks, lambda t: F.coalesce(F.get(frame_indices, 2 * t), F.element_at(frame_indices, -1)))


def coverage(clips: DataFrame, key: list[str]) -> DataFrame:
    """Clip counts per key from ``n_objects``, ``n_events`` and optional time columns."""
    status = ids.clip_status(F.col("n_objects"), F.col("n_events"))
    return clips.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_clips"),
        F.count_if(status == "annotated").alias("annotated_clips"),
        F.count_if(status == "motion_filtered").alias("motion_filtered_clips"),
        F.count_if(F.col("n_events") > 0).alias("clips_with_events"),
    )


def filtered_ranges(clips: DataFrame, key: list[str], pos: str, static: Column) -> DataFrame:
    """Maximal runs of static clips per key as (``first_pos``, ``last_pos``, ``n_clips``).

    ``pos`` counts the clips of a key without gaps, so ``pos`` minus the rank among the static
    clips is constant along a run.
    """
    ranked = row_index(clips.where(static).select(*key, pos), [pos], key, name="_rank")
    return (
        ranked.withColumn("_run", F.col(pos) - F.col("_rank"))
        .groupBy(*key, "_run")
        .agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("n_clips"))
        .drop("_run")
    )


def enrich_by_position(clips: DataFrame, stamps: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Attach the timestamps of the clip at the same position, or the fallback metadata.

    ``stamps`` has ``key``, ``pos``, ``frame_indices``, ``start_time``, ``end_time``,
    ``start_offset_sec`` and ``end_offset_sec``.
    """
    fields = {
        "frame_indices": F.array().cast("array<int>"),
        "start_time": F.lit(""),
        "end_time": F.lit(""),
        "start_offset_sec": F.lit(0.0),
        "end_offset_sec": F.lit(0.0),
    }
    joined = clips.join(stamps.select(*key, pos, *fields), [*key, pos], "left")
    filled = joined.select(*clips.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in fields.items()])
    return filled.withColumn("status", ids.clip_status(F.col("n_objects"), F.col("n_events")))
