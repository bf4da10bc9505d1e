"""Sample sets, split lists and graph tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipgraph.operators.ordering import row_index


def shard_assign(inputs: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard``: position in key order modulo the number of shards."""
    return row_index(inputs, [key], name="_at").withColumn("shard", (F.col("_at") % shards).cast("int")).drop("_at")


def write_splits(samples: DataFrame, path: str, id_col: str) -> None:
    """Samples partitioned by split, sorted by id within each file."""
    samples.repartitionByRange("split", id_col).sortWithinPartitions("split", id_col).write.mode("overwrite").partitionBy(
        "split"
    ).parquet(path)


def write_id_list(ids: DataFrame, path: str, id_col: str) -> None:
    ids.select(F.col(id_col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_ordered_ids(samples: DataFrame, path: str, id_col: str, split_col: str = "split", ranges: int | None = None) -> None:
    """One sorted id list for each split, as text files whose names follow the order.

    ``path/split=train/part-00000...`` and so on: the files of a split, read by name one after
    the other, are its ids in rising order, one a line, without a step that gathers a split in one
    task. Ids are texts without line breaks; repeated ids are repeated lines; null ids are left out, as
    are rows without a split. A list that exists is replaced.
    """
    ids = samples.select(F.col(split_col).cast("string").alias("split"), F.col(id_col).cast("string").alias("value"))
    # a range partition becomes one file of each split that it holds, numbered by the order of the ranges
    by = [ranges, "split", "value"] if ranges else ["split", "value"]
    ids.where("value is not null and split is not null").repartitionByRange(*by).sortWithinPartitions("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def read_ordered_ids(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """(split, pos, id): the lists of :func:`write_ordered_ids` with each id's place in its list, from 0.

    A file holds one range of the ids, so places are the rank in the file after the lines of all files before.
    """
    lines = spark.read.text(path).select("split", F.col("_metadata.file_name").alias("_file"), F.col("value").alias(id_col))
    counts = lines.groupBy("split", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("split").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("split", "_file").orderBy(id_col)) - 1
    placed = lines.withColumn("_at", within).join(starts, ["split", "_file"])
    return placed.select(F.col("split").cast("string").alias("split"), (F.col("_start") + F.col("_at")).alias("pos"), id_col)


def sample_list_scan(spark: SparkSession, path: str, samples: DataFrame, id_col: str) -> DataFrame:
    """Samples named in an id list; blank lines do not count."""
    listed = spark.read.text(path).select(F.trim("value").alias(id_col)).where(F.col(id_col) != "")
    return samples.join(listed, id_col, "left_semi")


def write_graph_tables(videos: DataFrame, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """``videos``, ``tracked_objects`` and ``events`` as tables, parents first.

    Objects are clustered by category and events by (video, frame), the columns the graph
    queries filter on, so that row groups can be skipped.
    """
    videos.write.mode("overwrite").parquet(f"{path}/videos")
    nodes.repartitionByRange("category", "video_id", "track_id").sortWithinPartitions("category", "video_id").write.mode(
        "overwrite"
    ).parquet(f"{path}/tracked_objects")
    edges.repartitionByRange("video_id", "frame", "event_seq").sortWithinPartitions("video_id", "frame").write.mode(
        "overwrite"
    ).parquet(f"{path}/events")


def read_graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("videos", "tracked_objects", "events"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
