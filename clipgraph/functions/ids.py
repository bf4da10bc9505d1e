"""Identifiers, labels and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_from_id(obj_id: Column) -> Column:
    """``person_01`` -> ``person``; ids without a numeric tail stay whole."""
    return F.regexp_replace(obj_id, "_[0-9]+$", "")


def event_id(position: Column) -> Column:
    return F.format_string("evt_%04d", position.cast("bigint"))


def sample_id(video_id: Column, clip_index: Column) -> Column:
    return F.format_string("%s_clip_%04d", video_id.cast("string"), clip_index.cast("bigint"))


def clamp_frame(frame: Column, length: int = 16) -> Column:
    return F.greatest(F.lit(0), F.least(frame, F.lit(length - 1)))


def clip_status(n_objects: Column, n_events: Column) -> Column:
    """Static iff both lists are empty or missing."""
    none = (F.coalesce(n_objects, F.lit(0)) == 0) & (F.coalesce(n_events, F.lit(0)) == 0)
    return F.when(none, F.lit("motion_filtered")).otherwise(F.lit("annotated"))


def first_present(fields: Column, names: list[str]) -> Column:
    """Value of the first name that is a key of the map, even when that value is null."""
    found = F.lit(None).cast("string")
    for name in reversed(names):
        found = F.when(F.map_contains_key(fields, name), F.element_at(fields, name)).otherwise(found)
    return found


# Accepted field names in order of preference.
ALIASES = {
    "obj_id": ["id", "obj_id"],
    "action": ["action", "action_type"],
    "agent": ["agent", "agent_id"],
    "target": ["target", "target_id"],
    "source": ["source", "source_id"],
    "destination": ["destination", "dest_id"],
    "frame": ["frame_index", "frame"],
}


def normalize_frame(frame: Column, frame_indices: Column, length: int = 16) -> Column:
    """Local position of a frame: itself below ``length``, else the nearest listed frame, lowest on ties."""
    distance = F.transform(frame_indices, lambda x: F.abs(x - frame))
    nearest = (F.array_position(distance, F.array_min(distance)) - 1).cast("int")
    return F.when(frame <= length - 1, frame).otherwise(nearest)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where its denominator is 0."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp, tp + fp), zero)
    r = F.coalesce(F.try_divide(tp, tp + fn), zero)
    f = F.coalesce(F.try_divide(2 * p * r, p + r), zero)
    return p, r, f
