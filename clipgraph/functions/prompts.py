"""Prompt text for the annotation model, one row per clip."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph import vocab

def example_json(axes: list[str]) -> str:
    """Example answer, made from the vocabulary: two objects with their first allowed values, and one event between them.

    Attributes follow the axis order; every other axis is left open to show that null is allowed.
    """
    first, last = vocab.CATEGORIES[0], vocab.CATEGORIES[-1]
    names = [f"{first}_01", f"{last}_01" if last != first else f"{last}_02"]
    filled = {axis: vocab.ATTRIBUTES[axis][0] for axis in axes[::2] if vocab.ATTRIBUTES.get(axis)}
    objects = [
        {"obj_id": name, "category": name.rsplit("_", 1)[0], "first_seen_frame": 2 * at,
         "attributes": {axis: filled.get(axis) if at else None for axis in axes}}
        for at, name in enumerate(names)
    ]
    # an action that needs neither of the two roles left open, and that no later step drops
    action = next(a for a, source, destination in vocab.ACTIONS if not source and not destination and a != vocab.NO_EVENT)
    told = {"event_id": "evt_001", "frame": 7, "action": action, "agent": names[0], "target": names[1]}
    return json.dumps({"objects": objects, "events": [told | {"source": None, "destination": None}]}, indent=2)


def system_prompt(
    categories: list[str] | None = None,
    actions: list[str] | None = None,
    attributes: dict[str, list[str]] | None = None,
) -> str:
    """Task description with the allowed categories, actions and attribute values."""
    attributes = vocab.ATTRIBUTES if attributes is None else attributes
    lines = [
        "You label what happens in short video clips and answer in JSON only.",
        "First list every object with obj_id (category_NN), category, first_seen_frame and attributes.",
        "Give each attribute axis one allowed value or null:",
        *[f"- {axis}: {', '.join(values)}" for axis, values in attributes.items()],
        "Then list every event with event_id (evt_NNN), frame, action, agent, target and, where they apply, "
        "source and destination; the four roles name objects by obj_id.",
        f"Categories: {', '.join(categories or vocab.CATEGORIES)}",
        f"Actions: {', '.join(actions or [a for a, _, _ in vocab.ACTIONS])}",
    ]
    return "\n".join(lines)


def user_prompt(n_frames: Column, fps: Column, axes: list[str] | None = None) -> Column:
    """Per-clip request with its frame count, sampling rate and the example answer."""
    axes = list(vocab.ATTRIBUTES) if axes is None else axes
    return F.concat(
        n_frames.cast("string"),
        F.lit(" frames sampled at "),
        fps.cast("string"),
        F.lit(" frames per second; the frame number is drawn at the top left of each.\nAnswer in this form:\n"),
        F.lit(example_json(axes)),
    )


def build_prompts(clips: DataFrame, n_frames: str, fps: Column) -> DataFrame:
    """Add ``system_prompt`` (one literal) and ``user_prompt``."""
    return clips.withColumn("system_prompt", F.lit(system_prompt())).withColumn(
        "user_prompt", user_prompt(F.col(n_frames), fps)
    )
