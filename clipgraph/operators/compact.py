"""Dictionary compaction of annotation documents and its inverse.

Object categories, attribute profiles and the frame formula are stored once per video; clips
refer to them. All steps are joins on dictionary keys, so a video with very many clips is
spread over tasks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipgraph.functions import ids, times
from clipgraph.operators.ordering import row_index
from clipgraph.operators.windows import rebuild_frame_indices
from clipgraph.vocab import AXES

# One-letter status codes.
STATUS_CODES = {"annotated": "a", "motion_filtered": "m"}


def sparse(attributes: Column) -> Column:
    """Attributes without their null values."""
    return F.map_filter(attributes, lambda axis, value: value.isNotNull())


def expand(attributes: Column, axes: list[str] = AXES) -> Column:
    """All axes in their fixed order, null where the sparse map has none."""
    keys = F.array(*map(F.lit, axes))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(attributes, k)))


def profile_key(attributes: Column) -> Column:
    """Canonical text of the non-null attributes, equal for equal maps."""
    entries = F.array_sort(F.map_entries(sparse(attributes)))
    return F.to_json(F.map_from_entries(entries))


EVENT_FIELDS = ["event_id", "frame", "action", "agent", "target", "source", "destination"]


def pack_event(fields: list[str] = EVENT_FIELDS) -> Column:
    """Event columns as one positional text array without trailing nulls."""
    full = F.array(*[F.col(c).cast("string") for c in fields])
    last = F.array_max(F.transform(full, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)))
    return F.slice(full, F.lit(1), last)


def unpack_event(packed: Column) -> dict[str, Column]:
    """Columns of a packed event."""
    cols = {name: F.get(packed, F.lit(i)) for i, name in enumerate(EVENT_FIELDS)}
    return cols | {"frame": cols["frame"].cast("int")}


def object_defs(objects: DataFrame, video: str, order: list[str]) -> DataFrame:
    """``(video, obj_id) -> category`` of the first occurrence."""
    first = F.min_by("category", F.struct(*order))
    return objects.groupBy(video, "obj_id").agg(first.alias("category"))


def attribute_profiles(objects: DataFrame, video: str, order: list[str]) -> DataFrame:
    """Distinct attribute profiles per video with ids in the order of first appearance.

    The number of profiles of a video is bounded by the attribute vocabulary, not by its rows:
    the rows collapse to profiles before anything is ordered.
    """
    keyed = objects.withColumn("profile", profile_key(F.col("attributes")))
    first = keyed.groupBy(video, "profile").agg(F.min(F.struct(*order)).alias("_first"))
    return row_index(first, ["_first"], [video], name="profile_id").drop("_first")


def frame_params(clips: DataFrame, video: str) -> DataFrame:
    """``step``, ``stride`` and ``length`` per video from its first two clips with frames."""
    fi = F.col("frame_indices")
    # Only three numbers of the frames are asked for, so no list is sorted or moved.
    used = clips.where(F.size(fi) > 0).select(
        video, "clip_index", F.size(fi).alias("_size"), F.coalesce(F.get(fi, F.lit(1)) - F.get(fi, F.lit(0)), F.lit(0)).alias("_step"),
        F.get(fi, F.lit(0)).alias("_head"),
    )
    # The rank filter is pushed below the shuffle, so at most two clips per video and task move. Copies of
    # a clip share its rank, so that the second one is never a copy of the first.
    ranked = used.withColumn("_rn", F.dense_rank().over(Window.partitionBy(video).orderBy("clip_index"))).where("_rn <= 2")
    row = ranked.groupBy(video).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("_size"))).alias("length"),
        F.max(F.when(F.col("_rn") == 1, F.col("_step"))).alias("step"),
        F.max(F.when(F.col("_rn") == 1, F.col("_head"))).alias("_a"),
        F.max(F.when(F.col("_rn") == 2, F.col("_head"))).alias("_b"),
    )
    single = F.col("step") * F.floor(F.col("length") / 2).cast("int")
    return row.select(video, "step", F.coalesce(F.col("_b") - F.col("_a"), single).alias("stride"), "length")


def irregular_clips(clips: DataFrame, params: DataFrame, video: str) -> DataFrame:
    """Clips whose frames differ from the formula of their video."""
    formula = rebuild_frame_indices(F.col("clip_index"), F.col("stride"), F.col("step"), F.col("_length"))
    joined = clips.join(params.withColumnRenamed("length", "_length"), video)
    return joined.where(F.col("frame_indices") != formula).select(video, "clip_index", "frame_indices")


def compact(
    clips: DataFrame, objects: DataFrame, events: DataFrame, video: str, order: list[str], event_pos: str
) -> dict[str, DataFrame]:
    """The five tables of a compacted corpus.

    ``clips``: (video, clip_index, status, frame_indices); ``objects`` and ``events`` carry the
    same keys. Returns ``params``, ``defs``, ``profiles``, ``clips``, ``objects``, ``events``.
    """
    params = frame_params(clips, video)
    defs = object_defs(objects, video, order)
    profiles = attribute_profiles(objects, video, order)
    odd = irregular_clips(clips, params, video).withColumnRenamed("frame_indices", "fi")
    code = F.create_map(*[F.lit(x) for p in STATUS_CODES.items() for x in p])
    short_clips = clips.join(odd, [video, "clip_index"], "left").select(
        video, F.col("clip_index").alias("i"), F.coalesce(F.element_at(code, F.col("status")), F.lit("a")).alias("s"), "fi"
    )
    keyed = objects.withColumn("profile", profile_key(F.col("attributes")))
    renamed = defs.withColumnRenamed("category", "_def")
    short_objects = (
        keyed.join(profiles, [video, "profile"])
        .join(renamed, [video, "obj_id"])
        .select(
            video,
            F.col("clip_index").alias("i"),
            *[c for c in order if c != "clip_index"],
            "obj_id",
            "first_seen_frame",
            "profile_id",
            F.when(~F.col("category").eqNullSafe(F.col("_def")), F.col("category")).alias("override"),
        )
    )
    short_events = events.select(video, F.col("clip_index").alias("i"), event_pos, pack_event().alias("e"))
    return {
        "params": params, "defs": defs, "profiles": profiles,
        "clips": short_clips, "objects": short_objects, "events": short_events,
    }


def restore(tables: dict[str, DataFrame], video: str) -> dict[str, DataFrame]:
    """Inverse of :func:`compact`: ``clips``, ``objects`` and ``events``."""
    names = F.create_map(*[F.lit(x) for k, v in STATUS_CODES.items() for x in (v, k)])
    formula = rebuild_frame_indices(F.col("i"), F.col("stride"), F.col("step"), F.col("length"))
    clips = tables["clips"].join(tables["params"], video, "left").select(
        video,
        F.col("i").alias("clip_index"),
        F.element_at(names, F.col("s")).alias("status"),
        F.coalesce("fi", formula, F.array().cast("array<int>")).alias("frame_indices"),
    )
    attrs = F.from_json("profile", "map<string,string>")
    objects = (
        tables["objects"].join(tables["profiles"], [video, "profile_id"])
        .join(tables["defs"], [video, "obj_id"], "left")
        .withColumnRenamed("i", "clip_index")
        .withColumn("category", F.coalesce("override", "category", ids.category_from_id(F.col("obj_id"))))
        .withColumn("attributes", expand(attrs))
        .drop("override", "profile", "profile_id")
    )
    fields = unpack_event(F.col("e"))
    events = tables["events"].select(
        video, F.col("i").alias("clip_index"),
        *[c for c in tables["events"].columns if c not in (video, "i", "e")],
        *[c.alias(n) for n, c in fields.items()],
    )
    return {"clips": clips, "objects": objects, "events": events}


def restored_times(clips: DataFrame, start_time: str, fps: str) -> DataFrame:
    """Offsets and times of restored clips, fractions kept."""
    fi = F.col("frame_indices")
    none = F.size(fi) == 0
    first = F.when(none, F.lit(0.0)).otherwise(F.get(fi, F.lit(0)) / F.col(fps))
    last = F.when(none, F.lit(0.0)).otherwise(F.element_at(fi, -1) / F.col(fps))
    begin = F.col(start_time)
    return clips.withColumns(
        {
            "start_offset_sec": first,
            "end_offset_sec": last,
            "start_ts": times.add_seconds(begin, first),
            "end_ts": times.add_seconds(begin, last),
        }
    )


def roundtrip_differences(before: dict[str, DataFrame], after: dict[str, DataFrame], columns: dict[str, list]) -> DataFrame:
    """Rows present on one side only, per table; empty when the round trip is lossless.

    ``columns`` gives the comparable (map-free) expressions of each table. Both sides are
    counted per distinct row in one pass instead of two set differences.
    """
    def counted(df: DataFrame, cols: list, n: int) -> DataFrame:
        # Columns and variables of lambdas are both numbered from 0. A union rewrites what is known of its sides
        # and fails where Spark mixes the two up, as for the first table of a session; of generated rows nothing is known.
        return df.select(F.inline(F.array(F.struct(*cols, F.lit(n).alias("_n")))))

    parts = []
    for name, cols in columns.items():
        left, right = counted(before[name], cols, 1), counted(after[name], cols, -1)
        keys = [c for c in left.columns if c != "_n"]
        odd = left.unionByName(right).groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0")
        parts.append(odd.select(F.lit(name).alias("part"), F.to_json(F.struct(*keys)).alias("row"), F.col("_n").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compression(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """Bytes before, bytes after and the percentage saved."""
    saved = F.coalesce(F.try_divide(100.0 * (before - after), before), F.lit(0.0))
    return before, after, saved
