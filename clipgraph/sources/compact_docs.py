"""The compact annotation document: one JSON text a video, written and read back.

Objects and events are positional arrays of mixed types without trailing nulls, attribute maps
are numbers into a list of profiles, categories stand once for each object id, and frames are a formula
but for clips that depart from it::

    {"format_version": 1, "video_id": ..., "frame_index_params": {"step": 20, "stride": 160, "length": 16},
     "object_defs": {"cup_01": "cup"}, "attribute_profiles": [{"color": "red"}],
     "clips": [{"i": 0, "s": "a", "o": [["cup_01", 3, 0]], "e": [["evt_1", 3, "use", "person_01"]]}]}
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgraph import schemas
from clipgraph.functions import ids, times
from clipgraph.operators import compact
from clipgraph.operators.windows import rebuild_frame_indices
from clipgraph.session import settle
from clipgraph.sources import annotations

# Fixed value: number of the format.
VERSION = 1

_HEAD = ["video_id", "video_path", "video_metadata", "coverage", "num_clips", "validation_stats"]
_MIXED = T.ArrayType(T.ArrayType(T.VariantType()))
SCHEMA = T.StructType([
    T.StructField("format_version", T.IntegerType()),
    *[f for f in schemas.ANNOTATION_DOC if f.name in _HEAD],
    T.StructField("frame_index_params", T.StructType([T.StructField(n, T.IntegerType()) for n in ("step", "stride", "length")])),
    T.StructField("object_defs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attribute_profiles", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("clips", T.ArrayType(T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("o", _MIXED),
        T.StructField("e", _MIXED), T.StructField("fi", T.ArrayType(T.IntegerType())),
    ]))),
])


def _quoted(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _joined(name: str, kind: str) -> Column:
    """Texts of one kind in order, with commas between."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", name)))), lambda x: x[name]), ",")


def from_tables(tables: dict[str, DataFrame], heads: DataFrame, object_pos: str = "obj_pos", event_pos: str = "event_pos") -> DataFrame:
    """(video_id, value): one compact document a video from the tables of ``compact.compact``.

    ``heads`` has video_id and any of video_path, video_metadata, coverage, num_clips, validation_stats.
    Parts of clips are folded by (video, clip), then clips and dictionaries by video: two aggregations, no join.
    """
    def rows(df: DataFrame, kind: str, pos: Column, text: Column, *key: str) -> DataFrame:
        return df.select("video_id", *key, F.lit(kind).alias("kind"), pos.alias("pos"), text.alias("text"))

    wide = lambda c: F.col(c).cast("bigint")
    other = F.when(F.col("override").isNull(), F.lit("")).otherwise(F.concat(F.lit(","), _quoted(F.col("override"))))
    obj = F.concat(
        F.lit("["), _quoted(F.col("obj_id")), F.lit(","), _number(F.coalesce("first_seen_frame", F.lit(0))), F.lit(","), _number(F.col("profile_id")),
        other, F.lit("]"))
    evt = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x, i: F.when(i == 1, _number(x)).otherwise(_quoted(x))), ","), F.lit("]"))
    clip = F.concat(F.lit('{"i":'), _number(F.col("i")), F.lit(',"s":'), _quoted(F.col("s")))
    frames = F.coalesce(F.concat(F.lit(',"fi":'), F.to_json("fi")), F.lit(""))
    zero = F.lit(0).cast("bigint")
    parts = (
        rows(tables["clips"], "clip", zero, clip, "i")
        .unionByName(rows(tables["clips"], "fi", zero, frames, "i"))
        .unionByName(rows(tables["objects"], "o", wide(object_pos), obj, "i"))
        .unionByName(rows(tables["events"], "e", wide(event_pos), evt, "i"))
    )

    def listed(kind: str) -> Column:
        body = F.col(f"_{kind}")
        return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(f',"{kind}":['), body, F.lit("]")))

    one = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("text")), ignorenulls=True)
    by_clip = parts.groupBy("video_id", "i").agg(
        one("clip").alias("_clip"), one("fi").alias("_fi"), _joined("text", "o").alias("_o"), _joined("text", "e").alias("_e")
    ).where("_clip is not null")
    whole = F.concat("_clip", listed("o"), listed("e"), "_fi", F.lit("}"))
    params = F.to_json(F.struct(*[F.col(c).cast("int").alias(c) for c in ("step", "stride", "length")]))
    texts = {f.name: f.dataType for f in schemas.ANNOTATION_DOC if f.name in _HEAD}
    head = F.to_json(
        F.struct(*[(F.col(c) if c in heads.columns else F.lit(None)).cast(t).alias(c) for c, t in texts.items()]), {"ignoreNullFields": "false"})
    pair = F.concat(_quoted(F.col("obj_id")), F.lit(":"), _quoted(F.col("category")))
    names = F.rank().over(Window.partitionBy("video_id").orderBy("obj_id")).cast("bigint")
    docs = (
        rows(by_clip, "c", wide("i"), whole)
        .unionByName(rows(tables["defs"], "d", names, pair))
        .unionByName(rows(tables["profiles"], "p", wide("profile_id"), F.col("profile")))
        .unionByName(rows(tables["params"], "f", zero, params))
        .unionByName(rows(heads, "h", zero, F.substring(head, F.lit(2), F.length(head) - 2)))
    ).groupBy("video_id").agg(one("h").alias("_h"), one("f").alias("_f"), *[_joined("text", k).alias(f"_{k}") for k in ("d", "p", "c")])
    value = F.concat(
        F.lit(f'{{"format_version":{VERSION},'), "_h", F.lit(',"frame_index_params":'), F.coalesce("_f", F.lit("null")),
        F.lit(',"object_defs":{'), "_d", F.lit('},"attribute_profiles":['), "_p", F.lit('],"clips":['), "_c", F.lit("]}"))
    return docs.where("_h is not null").select("video_id", value.alias("value"))


def encode(docs: DataFrame) -> DataFrame:
    """(video_id, value): annotation documents as compact text.

    Documents whose clips have numbers of their own are kept but for times and offsets of clips, which
    follow from the frames. Attribute axes without a value come back as null; a clip without a status
    counts as annotated.
    """
    docs = settle(docs)  # every table and dictionary is made from it
    clips = annotations.explode_clips(docs)
    objects, events = annotations.explode_objects(clips), annotations.explode_events(clips)
    tables = compact.compact(
        clips.select("video_id", "clip_index", "status", "frame_indices"), objects, events, "video_id", ["clip_index", "obj_pos"], "event_pos")
    return from_tables(tables, docs)


def write(compacted: DataFrame, path: str) -> None:
    """Compact documents as text, one a line."""
    compacted.select("value").write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Compact documents of a folder, one a line, parsed; a line that is no document of a known version raises."""
    parsed = spark.read.text(path).select(F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("_d")).select("_d.*")
    known = F.coalesce(F.col("format_version") == VERSION, F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("unknown format version "), _number(F.col("format_version"))))
    return parsed.withColumn("format_version", F.when(known, F.col("format_version")).otherwise(wrong.cast("int")))


def _iso(ts: Column) -> Column:
    """ISO text with the microseconds where there are any."""
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, times.iso(ts)).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _metadata(clip: Column) -> Column:
    params, video = F.col("frame_index_params"), F.col("video_metadata")
    none = F.array().cast("array<int>")
    formula = F.when(params.isNotNull(), rebuild_frame_indices(clip["i"], params["stride"], params["step"], params["length"]))
    frames = F.coalesce(clip["fi"], formula, none)
    fps = F.coalesce(video["source_fps"], F.lit(20.0))
    started = F.coalesce(video["video_start_time"], F.lit("")) != ""
    start = F.when(started, F.to_timestamp_ntz(video["video_start_time"]))
    shown = F.size(frames) > 0
    first, last = (F.when(shown, F.get(frames, at) / fps).otherwise(F.lit(0.0)) for at in (F.lit(0), F.size(frames) - 1))
    names = F.create_map(*[F.lit(x) for k, v in compact.STATUS_CODES.items() for x in (v, k)])
    timed = lambda c: F.when(started, c)
    return F.struct(
        clip["i"].alias("clip_index"), frames.alias("frame_indices"),
        _iso(times.add_seconds(start, first)).alias("start_time"), _iso(times.add_seconds(start, last)).alias("end_time"),
        timed(first).alias("start_offset_sec"), timed(last).alias("end_offset_sec"),
        F.coalesce(F.element_at(names, clip["s"]), F.lit("annotated")).alias("status"),
    )


def decode(compacted: DataFrame) -> DataFrame:
    """Annotation documents of parsed compact ones, each from its own row.

    Clips get the times of their first and last frame, with fractions; they have none where the
    document has no start time.
    """
    text = lambda v: F.variant_get(v, "$", "string")
    whole = lambda v: F.variant_get(v, "$", "int")

    def obj(o: Column) -> Column:
        name = text(F.get(o, F.lit(0)))
        category = F.coalesce(text(F.get(o, F.lit(3))), F.element_at("object_defs", name), ids.category_from_id(name))
        return F.struct(
            name.alias("obj_id"), category.alias("category"), whole(F.get(o, F.lit(1))).alias("first_seen_frame"),
            compact.expand(F.get("attribute_profiles", whole(F.get(o, F.lit(2))))).alias("attributes"))

    def evt(e: Column) -> Column:
        at = {n: F.get(e, F.lit(k)) for k, n in enumerate(compact.EVENT_FIELDS)}
        return F.struct(*[(whole(v) if n == "frame" else text(v)).alias(n) for n, v in at.items()])

    listed = lambda items, of, kind: F.coalesce(F.transform(items, of), F.array().cast(kind))
    body = schemas.CLIP
    clips = F.transform("clips", lambda c: F.struct(
        listed(c["o"], obj, body["objects"].dataType).alias("objects"), listed(c["e"], evt, body["events"].dataType).alias("events"),
        _metadata(c).alias("clip_metadata")))
    return compacted.select(*_HEAD, clips.alias("clips")).select(*schemas.ANNOTATION_DOC.names)
