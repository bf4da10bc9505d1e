"""Vocabularies of the data model and their frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Object categories in file order; the position is the category id and
# "unknown" takes the next id.
CATEGORIES = [
    "person", "hand", "chair", "desk", "laptop", "monitor", "phone", "keyboard", "mouse", "tablet", "pen",
    "notebook", "book", "bookshelf", "shelf", "cup", "drawer", "curtain", "jacket", "backpack", "box",
    "speaker", "microphone", "stool", "pc_case", "earbuds", "smartphone", "case",
]

# Fixed values: (action, requires_source, requires_destination) in file order; the position is the class id.
ACTIONS = [
    ("take_out", True, False),
    ("put_in", False, True),
    ("place_on", False, True),
    ("pick_up", True, False),
    ("hand_over", True, True),
    ("open", False, False),
    ("close", False, False),
    ("use", False, False),
    ("move", True, True),
    ("attach", False, True),
    ("detach", True, False),
    ("inspect", False, False),
    ("no_event", False, False),
]

# Attribute axes and their allowed values.
ATTRIBUTES = {
    "color": ["white", "black", "red", "blue", "green", "yellow", "orange", "brown", "pink", "purple", "gray",
              "silver", "beige", "transparent", "multicolored"],
    "material": ["metal", "plastic", "wooden", "glass", "ceramic", "fabric", "leather", "paper", "cardboard",
                 "rubber", "silicone", "mesh"],
    "position": ["on_floor", "on_desk", "on_shelf", "on_wall", "on_chair", "on_lap", "in_hand", "in_drawer",
                 "in_bag", "hanging", "mounted", "stacked"],
    "size": ["small", "medium", "large"],
    "state": ["open", "closed", "filled", "empty", "powered_on", "powered_off", "folded", "unfolded", "worn",
              "locked"],
    "orientation": ["upright", "tilted", "flat", "inverted", "sideways"],
    "pose": ["standing", "sitting", "crouching", "walking", "leaning", "reaching"],
}

# Axis order of the expanded attribute form.
AXES = ["color", "material", "position", "size", "state", "orientation", "pose"]

NO_EVENT = "no_event"
UNKNOWN = "unknown"


def category_vocab(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """``(category, category_id)`` with ``unknown`` as the last id."""
    rows = [*(names or CATEGORIES), UNKNOWN]
    return spark.createDataFrame([(n, i) for i, n in enumerate(rows)], "category string, category_id int")


def action_vocab(spark: SparkSession, rows: list[tuple[str, bool, bool]] | None = None) -> DataFrame:
    """``(action, action_id, requires_source, requires_destination)``."""
    data = [(n, i, s, d) for i, (n, s, d) in enumerate(rows or ACTIONS)]
    return spark.createDataFrame(data, "action string, action_id int, requires_source boolean, requires_destination boolean")


def attribute_vocab(spark: SparkSession) -> DataFrame:
    """``(axis, value)`` pairs."""
    return spark.createDataFrame([(a, v) for a, vs in ATTRIBUTES.items() for v in vs], "axis string, value string")


def attribute_literal(vocab: dict[str, list[str]] | None = None) -> Column:
    """The attribute vocabulary as one literal ``map<axis, array<value>>``."""
    parts: list[Column] = []
    for axis, values in (vocab or ATTRIBUTES).items():
        parts += [F.lit(axis), F.array(*map(F.lit, values))]
    return F.create_map(*parts)


def vocab_from_table(df: DataFrame, column: str, name: str, id_name: str) -> DataFrame:
    """Dense ids over the sorted distinct values of a column.

    The ids are dense over the distinct values, so the single ordered pass runs on the
    vocabulary (one row per distinct value after a partial distinct), never on the table.
    """
    from clipgraph.operators.ordering import row_index

    values = df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()
    return row_index(values, [name], name=id_name).withColumn(id_name, F.col(id_name).cast("int"))
