"""File inventories and what they have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Media extensions of the flat and of the recursive listing.
MEDIA = ["mp4", "avi", "mov", "mkv", "webm"]
MEDIA_RECURSIVE = ["mp4", "avi", "mov"]


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of every file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "length", "modificationTime")


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def media_files(files: DataFrame, extensions: list[str] = MEDIA) -> DataFrame:
    """Files with one of the extensions in any letter case, with their ``stem``."""
    wanted = files.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    return wanted.withColumn("stem", stem(F.col("path")))


def feature_inventory(files: DataFrame, video: str, path: str = "path", size: str = "length") -> DataFrame:
    """Number of clip files and total bytes per video."""
    clip = F.regexp_extract(F.col(path), r"clip_(\d+)", 1)
    return files.where(clip != "").groupBy(video).agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum(size).alias("n_bytes"), F.max(clip.cast("int")).alias("last_clip")
    )


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key), key, "left_anti")


def intersect_inventory(annotated: DataFrame, features: DataFrame, compacted: DataFrame, key: str, compact_key: str) -> DataFrame:
    """Annotated videos that have features, flagged where a compact annotation exists."""
    both = annotated.join(features.select(key), key, "left_semi")
    flag = compacted.select(compact_key).distinct().withColumn("_has", F.lit(True))
    return both.join(flag, compact_key, "left").withColumn("compact_available", F.coalesce("_has", F.lit(False))).drop("_has")


def smallest(inventory: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """The ``n`` videos with the fewest clips."""
    return inventory.orderBy(size, key).limit(n)


def dataset_manifest(clips: DataFrame, key: str, size: str, annotated: str, with_events: str, published: int | None = None) -> DataFrame:
    """Per video: clips, annotated clips, clips with events, megabytes; with corpus totals on each row.

    ``is_subset`` tells whether fewer than ``published`` videos (default: all) are listed.
    """
    per = clips.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.count_if(annotated).alias("n_annotated"),
        F.count_if(with_events).alias("n_with_events"),
        F.sum(size).alias("_bytes"),
    )
    totals = per.agg(
        F.struct(
            F.count(F.lit(1)).alias("total_videos"),
            F.sum("n_clips").alias("total_clips"),
            F.round(F.sum("_bytes") / 1e9, 2).alias("total_gb"),
        )
    ).scalar()
    out = per.withColumn("_t", totals).select("*", "_t.*").drop("_t")
    limit = F.lit(published) if published is not None else F.col("total_videos")
    return out.select(
        key, "n_clips", "n_annotated", "n_with_events", F.round(F.col("_bytes") / 1e6, 1).alias("size_mb"),
        "total_videos", "total_clips", "total_gb", (F.col("total_videos") < limit).alias("is_subset"),
    )
