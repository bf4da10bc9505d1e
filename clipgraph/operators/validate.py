"""Parsing and validation of clip annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph import schemas
from clipgraph.operators.ordering import prefix_sums
from clipgraph.session import broadcast_checked
from clipgraph.vocab import attribute_literal

# Patterns of valid identifiers.
OBJECT_ID = "^[a-z_]+_[0-9]+$"
EVENT_ID = "^evt_[0-9]+$"


# What comes off model text, in this order: pattern and what stays of a match.
_CLEANING = [
    (r"(?s)^.*?</think>", ""),
    (r"^\s+|\s+$", ""),
    (r"(?s)^.*?```json(.*?)(```.*)?$", "$1"),
    (r"(?s)^```[^\n]*\n(.*?)\s*(```)?$", "$1"),
    (r"^\s+|\s+$", ""),
]


def clean_text(raw: Column) -> Column:
    """Model text without the thinking part and without a code fence around the JSON."""
    for pattern, kept in _CLEANING:
        raw = F.regexp_replace(raw, pattern, kept)
    return raw


def parse_annotation(df: DataFrame, raw: str) -> DataFrame:
    """Add ``parsed``, ``objects`` and ``events`` from model text; unparsable text gives empty lists.

    An attribute list of the older form reads as no attributes.
    """
    body = clean_text(F.col(raw))
    # As the only item of an array the text must be one whole JSON value, nothing after it.
    whole = F.json_array_length(F.concat(F.lit("["), F.col("_body"), F.lit("]"))) == 1
    parsed = F.coalesce(F.col("_body").startswith("{") & whole, F.lit(False))
    staged = df.withColumn("_body", body).withColumn("parsed", parsed)
    read = F.from_json(F.when(F.col("parsed"), F.col("_body")), schemas.CLIP_BODY)
    none_obj = F.array().cast(schemas.CLIP_BODY["objects"].dataType)
    none_evt = F.array().cast(schemas.CLIP_BODY["events"].dataType)
    return (
        staged.withColumn("_read", read)
        .withColumn("objects", coerce_attributes(F.coalesce(F.col("_read.objects"), none_obj)))
        .withColumn("events", F.coalesce(F.col("_read.events"), none_evt))
        .drop("_body", "_read")
    )


def coerce_attributes(objects: Column) -> Column:
    """Missing (or older, list-form) attributes become an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.transform(objects, lambda o: o.withField("attributes", F.coalesce(o["attributes"], empty)))


def schema_validate(clips: DataFrame) -> DataFrame:
    """All-or-nothing check of ids, frames and required fields; a bad clip becomes empty."""

    def good_object(o: Column) -> Column:
        named = F.coalesce(o["obj_id"].rlike(OBJECT_ID), F.lit(False)) & o["category"].isNotNull()
        return named & F.coalesce(o["first_seen_frame"] >= 0, F.lit(False))

    def good_event(e: Column) -> Column:
        named = F.coalesce(e["event_id"].rlike(EVENT_ID), F.lit(False)) & e["action"].isNotNull() & e["agent"].isNotNull()
        return named & F.coalesce(e["frame"] >= 0, F.lit(False))

    ok = F.forall("objects", good_object) & F.forall("events", good_event)
    if "parsed" in clips.columns:
        ok = F.col("parsed") & ok
    checked = clips.withColumn("valid", ok)
    none_obj = F.array().cast(clips.schema["objects"].dataType)
    none_evt = F.array().cast(clips.schema["events"].dataType)
    return checked.withColumns(
        {
            "objects": F.when(F.col("valid"), F.col("objects")).otherwise(none_obj),
            "events": F.when(F.col("valid"), F.col("events")).otherwise(none_evt),
        }
    )


def fix_attributes(objects: DataFrame, vocab: dict[str, list[str]] | None = None) -> DataFrame:
    """Drop unknown axes, null out values off the vocabulary, and list a warning for each."""
    known = attribute_literal(vocab)
    attrs = F.col("attributes")

    def bad_value(axis: Column, value: Column) -> Column:
        return value.isNotNull() & ~F.array_contains(F.element_at(known, axis), value)

    kept = F.map_filter(attrs, lambda axis, value: F.map_contains_key(known, axis))
    fixed = F.transform_values(
        kept, lambda axis, value: F.when(bad_value(axis, value), F.lit(None)).otherwise(value)
    )

    def warn(entry: Column) -> Column:
        head = F.concat(F.lit("Object "), F.col("obj_id"))
        return F.when(
            ~F.map_contains_key(known, entry["key"]), F.concat(head, F.lit(": unknown attribute axis "), entry["key"])
        ).when(
            bad_value(entry["key"], entry["value"]),
            F.concat(head, F.lit(": value outside the vocabulary of "), entry["key"], F.lit(": "), entry["value"]),
        )

    warnings = F.filter(F.transform(F.map_entries(attrs), warn), lambda w: w.isNotNull())
    return objects.withColumn("warnings", warnings).withColumn("attributes", fixed)


ROLES = ["agent", "target", "source", "destination"]


def validate_events(events: DataFrame, objects: DataFrame, actions: DataFrame, clip: str) -> DataFrame:
    """Add ``keep`` and ``warnings`` to each event.

    An event is dropped when its action is not in ``actions`` or a role names an object the
    clip does not have. A kept event is only warned about a missing required source or
    destination. The action vocabulary is broadcast after a check of its size; the four role
    lookups are plain equi joins on (clip, object id), which the adaptive plan splits when a clip is hot.
    """
    known = objects.select(clip, "obj_id").distinct()
    out = events.join(broadcast_checked(actions), "action", "left")
    for role in ROLES:
        side = known.select(F.col(clip).alias("_clip"), F.col("obj_id").alias(f"_{role}"))
        on = (F.col(clip) == F.col("_clip")) & (F.col(role) == F.col(f"_{role}"))
        out = out.join(side, on, "left").drop("_clip")

    def lost(role: str) -> Column:
        missing = F.col(f"_{role}").isNull()
        return missing if role == "agent" else F.col(role).isNotNull() & missing

    unknown = F.col("action_id").isNull()
    keep = ~unknown
    for role in ROLES:
        keep = keep & ~lost(role)
    # fixed values: wording of the warnings
    said = F.concat(F.lit("Event "), F.col("event_id"), F.lit(": "))
    notes = [F.when(unknown, F.concat(said, F.lit("unknown action '"), F.col("action"), F.lit("'")))]
    notes += [
        F.when(lost(r), F.concat(said, F.lit(f"{r} '"), F.coalesce(r, F.lit("null")), F.lit("' not in objects")))
        for r in ROLES
    ]
    notes += [
        F.when(
            F.col("_keep") & F.col(f"requires_{r}") & F.col(r).isNull(),
            F.concat(said, F.lit("action '"), F.col("action"), F.lit(f"' requires {r} but none provided")),
        )
        for r in ("source", "destination")
    ]
    warnings = F.filter(F.array(*notes), lambda w: w.isNotNull())
    return out.withColumn("_keep", keep).select(*events.columns, F.col("_keep").alias("keep"), warnings.alias("warnings"))


def _placed(events: DataFrame, clip: str, frame: str, pos: str) -> tuple[DataFrame, Column]:
    """Events with ``sorted_pos``, their place by (frame, pos), and whether the one before them there had a later ``pos``.

    The order by ``pos`` is the order by (frame, pos) iff ``pos`` never falls along the latter, so one sort shows both.
    """
    one = F.lit(1).cast("bigint")
    placed = prefix_sums(events, [frame, pos], {"sorted_pos": one}, [clip], {"_before": pos})
    # as structs, nulls come first, as they do in the order
    return placed.withColumn("sorted_pos", F.col("sorted_pos") - 1), F.struct(F.col("_before").alias("p")) > F.struct(F.col(pos).alias("p"))


def order_events(events: DataFrame, clip: str, frame: str, pos: str) -> DataFrame:
    """Add the position by (frame, pos) and whether sorting moved any event of the clip."""
    placed, falls = _placed(events, clip, frame, pos)
    moved = placed.groupBy(clip).agg(F.max(falls).alias("resorted"))
    return placed.drop("_before").join(moved, clip)


def clips_out_of_order(events: DataFrame, clip: str, frame: str, pos: str) -> DataFrame:
    """The clips of which sorting by (frame, pos) moves an event, one row each."""
    narrow = events.where(F.col(clip).isNotNull()).select(clip, frame, pos)
    placed, falls = _placed(narrow, clip, frame, pos)
    return placed.where(falls).select(clip).distinct()


def validation_stats(checked: DataFrame, clips: DataFrame, extra_warnings: DataFrame | None = None) -> DataFrame:
    """One row of totals over validated events (``keep``, ``warnings``) of ``clips``."""
    totals = checked.agg(
        F.count(F.lit(1)).alias("total_events_input"),
        F.count_if("keep").alias("total_events_output"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("_warned"),
    )
    n_clips = clips.agg(F.count(F.lit(1)).alias("total_annotations"))
    extra = extra_warnings.scalar() if extra_warnings is not None else F.lit(0)
    row = totals.withColumn("total_annotations", n_clips.scalar()).withColumn("_extra", extra)
    lost = F.col("total_events_input") - F.col("total_events_output")
    return row.select(
        "total_annotations",
        "total_events_input",
        "total_events_output",
        lost.alias("total_events_discarded"),
        F.round(F.coalesce(F.try_divide(lost, F.col("total_events_input")), F.lit(0.0)), 4).alias("discard_rate"),
        (F.col("_warned") + F.coalesce(F.col("_extra"), F.lit(0))).alias("total_warnings"),
    )


def validation_stats_by(checked: DataFrame, clips: DataFrame, by: list[str], resorted: DataFrame | None = None) -> DataFrame:
    """The totals of ``validation_stats`` for each group of ``by``.

    ``clips`` has one row an annotation, ``resorted`` one row an annotation whose events were out of order.
    ``checked`` may hold the number of warnings as ``n_warnings`` in place of their texts. All rows meet in one aggregation; groups without events have zeros.
    """
    zero = {c: F.lit(0).cast("bigint") for c in ("annotations", "events", "kept", "warned")}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*by, *[given.get(c, z).cast("bigint").alias(f"_{c}") for c, z in zero.items()])

    one = F.lit(1)
    warned = F.col("n_warnings") if "n_warnings" in checked.columns else F.size("warnings")
    parts = rows(clips, annotations=one).unionByName(rows(checked, events=one, kept=F.col("keep").cast("int"), warned=warned))
    if resorted is not None:
        parts = parts.unionByName(rows(resorted, warned=one))
    sums = parts.groupBy(*by).agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in zero])
    lost = F.col("_events") - F.col("_kept")
    return sums.select(
        *by, F.col("_annotations").alias("total_annotations"), F.col("_events").alias("total_events_input"),
        F.col("_kept").alias("total_events_output"), lost.alias("total_events_discarded"),
        F.round(F.coalesce(F.try_divide(lost, F.col("_events")), F.lit(0.0)), 4).alias("discard_rate"), F.col("_warned").alias("total_warnings"),
    )
