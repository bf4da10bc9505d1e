"""Training-sample assembly: joins of annotations with features, objects and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import ids
from clipgraph.operators.ordering import row_index
from clipgraph.session import broadcast_checked

ENCODED = [
    "action_class", "agent_track_id", "target_track_id", "source_track_id", "dest_track_id", "event_frame_index",
]


def clips_with_features(clips: DataFrame, features: DataFrame, key: list[str]) -> DataFrame:
    """Annotated (not static) clips that have a feature file."""
    moving = clips.where(ids.clip_status(F.col("n_objects"), F.col("n_events")) == "annotated")
    return moving.join(features.select(*key), key, "left_semi")


def lookup_category(df: DataFrame, known: DataFrame, name: str, unknown_id: int) -> DataFrame:
    """Add ``category_id``; names off the vocabulary get ``unknown_id``.

    A vocabulary holds one row per distinct name; it is broadcast after a check of its size.
    """
    return df.join(broadcast_checked(known.select(name, "category_id")), name, "left").withColumn(
        "category_id", F.coalesce("category_id", F.lit(unknown_id))
    )


def object_index(objects: DataFrame, clip: str, order: list[str]) -> DataFrame:
    """Add ``idx``: 0-based position of the object in its clip."""
    return row_index(objects, order, [clip], name="idx")


def join_roles(events: DataFrame, placed: DataFrame, clip: str) -> DataFrame:
    """Object positions of the four roles; agent and target must exist, source and destination may not.

    An object listed more than once in a clip counts at its last position.
    """
    out = events
    placed = placed.groupBy(clip, "obj_id").agg(F.max("idx").alias("idx"))
    for role, how, name in (
        ("agent", "inner", "agent_idx"),
        ("target", "inner", "target_idx"),
        ("source", "left", "source_idx"),
        ("destination", "left", "dest_idx"),
    ):
        side = placed.select(clip, F.col("obj_id").alias(role), F.col("idx").alias(name))
        out = out.join(side, [clip, role], how)
    return out


def encode_events(events: DataFrame, placed: DataFrame, actions: DataFrame, clip: str, length: int = 16) -> DataFrame:
    """Events with class ids, object positions and clamped frames; unknown actions and missing roles go."""
    known = events.join(broadcast_checked(actions.select("action", "action_id")), "action")
    out = join_roles(known, placed, clip)
    return out.select(
        *events.columns,
        F.col("action_id").alias("action_class"),
        F.col("agent_idx").alias("agent_track_id"),
        F.col("target_idx").alias("target_track_id"),
        F.col("source_idx").alias("source_track_id"),
        F.col("dest_idx").alias("dest_track_id"),
        ids.clamp_frame(F.col("frame"), length).alias("event_frame_index"),
    )
