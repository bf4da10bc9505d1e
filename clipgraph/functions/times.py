"""Frame, offset and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The start-time prefix of a video id and the text form of timestamps.
VIDEO_ID_TIME = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})_"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def parse_start_time(video_id: Column, strict: bool = False) -> Column:
    """TIMESTAMP_NTZ from ``YYYYMMDD_HHMMSS_*``; null (or an error when strict) for other ids."""
    digits = F.regexp_replace(F.regexp_extract(video_id, VIDEO_ID_TIME + "?", 0), "[^0-9]", "")
    parsed = F.when(
        video_id.rlike(VIDEO_ID_TIME), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    )
    if not strict:
        return parsed
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("no start time in video id "), video_id)).cast("timestamp_ntz")
    )


def add_seconds(start: Column, seconds: Column) -> Column:
    """start + seconds, kept to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.rint(seconds * 1e6).cast("bigint"), start)


def iso(ts: Column) -> Column:
    """ISO text cut (not rounded) to seconds."""
    return F.date_format(ts, ISO_SECONDS)


def offset_to_iso(start: Column, seconds: Column) -> Column:
    return iso(add_seconds(start, seconds))


def frame_to_time(start: Column, frame: Column, fps: Column) -> Column:
    return add_seconds(start, frame / fps)


def frame_step(source_fps: Column, target_fps: float = 1.0) -> Column:
    """Source frames per sampled frame: half-even rounding, at least 1."""
    return F.greatest(F.lit(1), F.bround(source_fps / F.lit(float(target_fps)), 0).cast("int"))


def sampled_count(total_frames: Column, step: Column) -> Column:
    """How many frames a step keeps: ceil(total / step)."""
    return F.ceil(total_frames / step).cast("int")


def duration_sec(total_frames: Column, fps: Column) -> Column:
    return total_frames / F.greatest(fps, F.lit(1e-6))
