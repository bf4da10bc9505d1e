"""Annotation documents: reading, taking apart, nesting and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgraph import schemas
from clipgraph.functions import times


def scan_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read annotation documents: one per file, or one per line with ``multi_line=False``.

    A missing video id is the file name without ``.json``; missing clips are an empty list.
    """
    docs = spark.read.schema(schemas.ANNOTATION_DOC).option("multiLine", multi_line).json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    none = F.array().cast(docs.schema["clips"].dataType)
    return docs.withColumn("video_id", F.coalesce("video_id", stem)).withColumn("clips", F.coalesce("clips", none))


def explode_clips(docs: DataFrame) -> DataFrame:
    """One row per clip with its position, metadata, objects and events."""
    rows = docs.select("video_id", F.posexplode_outer("clips").alias("clip_pos", "_c")).where("_c is not null")
    index = F.coalesce(F.col("_c.clip_metadata.clip_index"), F.lit(0))
    return rows.select(
        "video_id", "clip_pos", index.alias("clip_index"), F.col("_c.clip_metadata.frame_indices").alias("frame_indices"),
        F.col("_c.clip_metadata.status").alias("status"), F.col("_c.objects").alias("objects"), F.col("_c.events").alias("events"),
    )


def explode_objects(clips: DataFrame) -> DataFrame:
    rows = clips.select("video_id", "clip_index", F.posexplode("objects").alias("obj_pos", "_o"))
    return rows.select("video_id", "clip_index", "obj_pos", "_o.*")


def explode_events(clips: DataFrame) -> DataFrame:
    rows = clips.select("video_id", "clip_index", F.posexplode("events").alias("event_pos", "_e"))
    return rows.select("video_id", "clip_index", "event_pos", "_e.*")


def _nest_clips(clips: DataFrame, objects: DataFrame, events: DataFrame, event_order: str) -> DataFrame:
    """(video_id, clip_index, clip) with the clip's objects by ``obj_pos`` and its events by ``event_order``."""
    meta = F.struct(
        F.col("clip_index").cast("int").alias("clip_index"), "frame_indices", "start_time", "end_time",
        "start_offset_sec", "end_offset_sec", "status",
    )
    wanted = {"start_time": "string", "end_time": "string", "start_offset_sec": "double", "end_offset_sec": "double"}
    full = clips.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in clips.columns})
    attrs = F.array_sort(F.map_entries("attributes"))
    obj = F.struct("obj_id", "category", "first_seen_frame", attrs.alias("attributes"))
    evt = F.struct(*schemas.EVENT.names)

    def item(df: DataFrame, kind: int, pos, **parts) -> DataFrame:
        cols = [parts[c].alias(c) if c in parts else F.lit(None).alias(c) for c in ("meta", "obj", "evt")]
        return df.select("video_id", "clip_index", F.lit(kind).alias("kind"), pos.cast("bigint").alias("pos"), *cols)

    items = (
        item(full, 0, F.lit(0), meta=meta)
        .unionByName(item(objects, 1, F.col("obj_pos"), obj=obj))
        .unionByName(item(events, 2, F.col(event_order), evt=evt))
    )

    def listed(name: str):
        return F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("pos", name))))

    by_clip = items.groupBy("video_id", "clip_index").agg(
        listed("obj").alias("_o"), listed("evt").alias("_e"), F.first("meta", ignorenulls=True).alias("clip_metadata")
    )
    restored = F.transform("_o", lambda x: x["obj"].withField("attributes", F.map_from_entries(x["obj"]["attributes"])))
    return by_clip.select(
        "video_id", "clip_index",
        F.struct(restored.alias("objects"), F.transform("_e", lambda x: x["evt"]).alias("events"), "clip_metadata").alias("clip"),
    )


def _in_order(name: str) -> Column:
    order = lambda a, b: a["clip_index"] - b["clip_index"]
    return F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("clip_index", name))), order)


def nest_documents(clips: DataFrame, objects: DataFrame, events: DataFrame, event_order: str) -> DataFrame:
    """Documents ``(video_id, num_clips, clips)`` from clip, object and event rows, one for each video whatever its size.

    Clips come in ``clip_index`` order, objects by ``obj_pos``, events by ``event_order``.
    """
    docs = _nest_clips(clips, objects, events, event_order).groupBy("video_id").agg(
        F.count(F.lit(1)).cast("int").alias("num_clips"), _in_order("clip").alias("_c"))
    return docs.select("video_id", "num_clips", F.transform("_c", lambda x: x["clip"]).alias("clips"))


def static_ranges(clips: Column) -> Column:
    """Times of the maximal runs of motion-filtered clips in a document's clip list (a column, not an expression).

    Clips without times end a run and start none.
    """
    def static(c: Column) -> Column:
        meta = c["clip_metadata"]
        return F.coalesce((meta["status"] == "motion_filtered") & (F.coalesce(meta["start_time"], F.lit("")) != ""), F.lit(False))

    def edges(step: int, side: str) -> Column:
        at_edge = F.transform(clips, lambda c, i: F.when(
            static(c) & ~static(F.get(clips, i + step)), F.coalesce(c["clip_metadata"][side], F.lit(""))))
        return F.filter(at_edge, lambda t: t.isNotNull())

    return F.zip_with(edges(-1, "start_time"), edges(1, "end_time"), lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def annotation_documents(
    clips: DataFrame, objects: DataFrame, events: DataFrame, event_order: str, videos: DataFrame, validation: DataFrame,
) -> DataFrame:
    """Whole annotation documents: ``nest_documents`` with the path, metadata, coverage and validation of each video.

    ``videos``: video_id, video_path, start_ts (TIMESTAMP_NTZ), source_fps, target_fps, total_frames,
    duration_sec; ``validation``: video_id and the totals of ``validation_stats``. Clips carry their
    times. One row a video of each joins the clips in the aggregation that nests them, so no part
    needs a join of its own. Videos without clips give documents without clips; a video that
    ``videos`` or ``validation`` lacks has null there.
    """
    start, end = times.iso(F.col("start_ts")), times.offset_to_iso(F.col("start_ts"), F.col("duration_sec"))
    about = F.struct("video_path", F.struct(
        start.alias("video_start_time"), F.bround("source_fps", 2).alias("source_fps"), F.col("target_fps").cast("double").alias("target_fps"),
        F.col("total_frames").cast("int").alias("total_frames"), F.bround("duration_sec", 1).alias("duration_sec"), end.alias("video_end_time"),
    ).alias("video_metadata"))
    stats = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.VALIDATION_STATS])
    # null clips of these rows come from the outer union of the columns
    rows = (
        _nest_clips(clips, objects, events, event_order)
        .unionByName(videos.select("video_id", about.alias("about")), allowMissingColumns=True)
        .unionByName(validation.select("video_id", stats.alias("validation_stats")), allowMissingColumns=True)
    )
    docs = rows.groupBy("video_id").agg(
        _in_order("clip").alias("_c"), F.first("about", ignorenulls=True).alias("_a"),
        F.first("validation_stats", ignorenulls=True).alias("validation_stats"),
    ).withColumn("clips", F.transform("_c", lambda x: x["clip"]))

    def number(which) -> Column:
        return F.size(F.filter("clips", which))

    meta = F.col("_a.video_metadata")
    coverage = F.struct(
        F.size("clips").alias("total_clips"), number(lambda c: c["clip_metadata"]["status"] == "annotated").alias("annotated_clips"),
        number(lambda c: c["clip_metadata"]["status"] == "motion_filtered").alias("motion_filtered_clips"),
        number(lambda c: F.size(c["events"]) > 0).alias("clips_with_events"),
        F.concat_ws(" ~ ", meta["video_start_time"], meta["video_end_time"]).alias("time_range"),
        static_ranges(F.col("clips")).alias("motion_filtered_ranges"),
    )
    return docs.select(
        "video_id", F.col("_a.video_path").alias("video_path"), meta.alias("video_metadata"), coverage.alias("coverage"),
        F.size("clips").alias("num_clips"), "validation_stats", "clips",
    )


def to_json(docs: DataFrame) -> DataFrame:
    """Documents as JSON text; nulls are kept."""
    body = F.struct(F.col("video_id").cast("string").alias("video_id"), *[c for c in docs.columns if c != "video_id"])
    return docs.select("video_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_annotation_docs(docs: DataFrame, path: str, per_video: bool = False) -> None:
    """Write documents as text: one per line, or one folder per video with ``per_video``.

    One line per document suits many small videos; per-video folders are for exchange with
    tools that want a file each.
    """
    text = to_json(docs)
    if per_video:
        text.write.mode("overwrite").partitionBy("video_id").text(path)
    else:
        text.select("value").write.mode("overwrite").text(path)
