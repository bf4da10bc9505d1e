"""Ranks over files that are small on disk and large in a sort."""

from pyspark.sql import functions as F

from clipgraph.operators import ordering


def test_rows_count_where_files_are_small(spark, tmp_path):
    path, n = str(tmp_path / "t"), 2_500_000
    spark.range(n).select((F.col("id") * 7919 % n).alias("k")).write.parquet(path)
    df = spark.read.parquet(path).select(F.format_string("19950823_%012d", "k").alias("name"), "k")
    assert 1 << 20 < int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 64 << 20
    placed = ordering.row_index(df, ["name"], name="i", buckets=16)
    assert "_bucket" in placed._jdf.queryExecution().toString()
    assert placed.where("i <> k").isEmpty() and placed.count() == n
    # few rows of the same files take the plain window, without a sample
    assert "_bucket" not in ordering.row_index(df.where("k < 1000"), ["name"], name="i", buckets=16)._jdf.queryExecution().toString()
