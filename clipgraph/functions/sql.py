"""The main expressions as SQL functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOX = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_INTER = (
    "greatest(0D, least(a[2], b[2]) - greatest(a[0], b[0])) * greatest(0D, least(a[3], b[3]) - greatest(a[1], b[1]))"
)
_AREA_A, _AREA_B = "(a[2] - a[0]) * (a[3] - a[1])", "(b[2] - b[0]) * (b[3] - b[1])"

FUNCTIONS = {
    "box_iou": (
        _BOX, "DOUBLE",
        f"CASE WHEN {_AREA_A} + {_AREA_B} - {_INTER} <= 0 THEN 0D ELSE {_INTER} / ({_AREA_A} + {_AREA_B} - {_INTER}) END",
    ),
    "box_containment": (_BOX, "DOUBLE", f"{_INTER} / greatest({_AREA_A}, 1e-6D)"),
    "normalize_frame": (
        "frame INT, frames ARRAY<INT>", "INT",
        "CASE WHEN frame <= 15 THEN frame ELSE array_min(transform(frames, (x, i) -> struct(abs(x - frame) AS d, i AS i))).i END",
    ),
    "prf": (
        "tp BIGINT, fp BIGINT, fn BIGINT", "STRUCT<precision: DOUBLE, recall: DOUBLE, f1: DOUBLE>",
        "named_struct('precision', coalesce(try_divide(tp, tp + fp), 0D), 'recall', coalesce(try_divide(tp, tp + fn), 0D), "
        "'f1', coalesce(try_divide(2D * tp, 2 * tp + fp + fn), 0D))",
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session."""
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
