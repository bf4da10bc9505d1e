"""Decoding of model outputs: boxes, query heads, pointers, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays
from clipgraph.session import broadcast_checked

HEADS = ["action", "agent_ptr", "target_ptr", "source_ptr", "dest_ptr", "frame"]


def boxes_to_pixels(raw: DataFrame, width: int, height: int) -> DataFrame:
    """Parallel ``ids``, ``probs``, ``boxes`` (normalised xywh) to one pixel-corner row per box.

    A missing probability is 0.0.
    """
    # A missing mask stands for a 1x1 image, so callers pass width = height = 1 in that case.
    others = [c for c in raw.columns if c not in ("ids", "probs", "boxes")]
    rows = raw.select(*others, F.explode(F.arrays_zip("ids", "probs", "boxes")).alias("_z")).where("_z.ids is not null")
    b = F.col("_z.boxes")
    return rows.select(
        *others,
        F.col("_z.ids").alias("track_id"),
        F.coalesce(F.col("_z.probs"), F.lit(0.0)).alias("score"),
        (b[0] * width).alias("x1"),
        (b[1] * height).alias("y1"),
        ((b[0] + b[2]) * width).alias("x2"),
        ((b[1] + b[3]) * height).alias("y2"),
    )


def active_queries(pred: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Add ``score`` and keep the queries at (or, when strict, above) the threshold."""
    scored = pred.withColumn("score", arrays.sigmoid(F.col("interaction")))
    return scored.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def argmax_heads(pred: DataFrame) -> DataFrame:
    """Replace each head's logits by the position of their maximum."""
    return pred.withColumns({h: arrays.argmax(F.col(h)) for h in HEADS})


def label_lookup(df: DataFrame, id_col: str, names: DataFrame, out: str, prefix: str) -> DataFrame:
    """Name of an id from a small ``(id, name)`` frame, else ``prefix`` + id.

    The names are broadcast after a check of their number.
    """
    joined = df.join(broadcast_checked(names), F.col(id_col) == names["id"], "left")
    named = F.coalesce(names["name"], F.concat(F.lit(prefix), F.col(id_col).cast("string")))
    return joined.withColumn(out, named).drop("id", "name")


def slot_literal(slots: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])


def decode_pointers(heads: DataFrame, slot_map: Column, n_objects: int) -> DataFrame:
    """Slot numbers to track ids.

    Agent and target keep an unmapped slot number; source and destination become null when
    unmapped or when they point at the "none" slot ``n_objects``.
    """
    required = {"agent_track_id": "agent_ptr", "target_track_id": "target_ptr"}
    optional = {"source_track_id": "source_ptr", "destination_track_id": "dest_ptr"}
    cols = {n: F.coalesce(F.element_at(slot_map, F.col(c)), F.col(c)) for n, c in required.items()}
    cols |= {n: F.when(F.col(c) < n_objects, F.element_at(slot_map, F.col(c))) for n, c in optional.items()}
    return heads.withColumns(cols)


def decode_frame(slot: Column, frame_indices: Column) -> Column:
    """The listed source frame of a slot; a slot beyond the list stays as it is."""
    return F.coalesce(F.get(frame_indices, slot), slot)


def events_from_predictions(
    pred: DataFrame,
    slot_map: Column,
    n_objects: int,
    action_names: DataFrame,
    frame_indices: Column,
    threshold: float = 0.5,
) -> DataFrame:
    """Active queries as event rows with names, track ids and source frames."""
    heads = argmax_heads(active_queries(pred, threshold))
    tracks = decode_pointers(heads, slot_map, n_objects)
    named = label_lookup(tracks, "action", action_names, "action_name", "action_")
    keep = [c for c in pred.columns if c not in (*HEADS, "interaction")]
    return named.select(
        *keep,
        F.col("action_name").alias("action"),
        "agent_track_id",
        "target_track_id",
        "source_track_id",
        "destination_track_id",
        decode_frame(F.col("frame"), frame_indices).alias("frame"),
        F.col("score").alias("confidence"),
    )
