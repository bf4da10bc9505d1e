"""From documents to shards: toxic texts, near copies and benchmark texts go, sources are mixed, rows are dealt to shards.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns
the columns of ``docs`` (the last one adds those of its shards). Columns other than doc_id, text and
source pass through whatever their names. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgraph.llm import decontaminate, langid, mixing, sharding, simhash, toxicity
from clipgraph.llm.common import drop_folder, table
from clipgraph.session import checkpoint_dir

USED = ["doc_id", "text", "source"]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and source, and all other columns as one struct, out of the way of the operators' own columns."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in USED]
    return docs.select(*USED, (F.struct(*rest) if rest else F.lit(None)).alias("__others"))


def _unpacked(packed: DataFrame, columns: list[str], more: list[str] | None = None) -> DataFrame:
    return packed.select(*[F.col(c if c in USED else f"__others.`{c}`").alias(c) for c in columns], *(more or []))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a toxicity of 0.7 or more go; the model learns from labelled texts among ``docs``.

    Null, empty and wordless texts have a low score and stay; equal texts share their score, and repeated
    rows their fate. Without a toxic or a clean labelled text nothing is learned and all rows stay.
    """
    labels = table(spark, sf_dir, "labels").filter(~langid.held_out(F.col("doc_id")))
    model = toxicity.learn(docs, labels)
    return _unpacked(toxicity.score(_packed(docs), model, threshold=0.7).filter("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or nearly equal texts stays, the one with the smallest doc_id.

    Texts are near copies from a similarity of 0.8 of their sets of five-word shingles on, and over chains of such
    pairs. Null, empty and blank texts are never copies and stay; of rows with one doc_id and text one stays; a
    null doc_id counts as larger than all others.
    """
    return _unpacked(simhash.drop_near_copies(_packed(docs), shingle=5, similarity=0.8), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item in full, go.

    Null and wordless texts hold nothing and stay, null and wordless items are in nothing; repeated rows share
    their fate. An empty benchmark lets all rows stay.
    """
    found = decontaminate.contamination(_packed(docs), table(spark, sf_dir, "benchmark"), window=10)
    return _unpacked(found.filter("not contaminated"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice, towards equal token shares; every document is there at least once.

    A null source is a source of its own. Texts without words have no tokens and come once for each whole
    epoch; repeated rows are documents each, ties are ordered by the digest of doc_id and tokens.
    """
    return _unpacked(mixing.mix(_packed(docs), entropy=1.0, repetition=2.0), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of 24, and their place in it.

    A null doc_id goes where 0 goes. Repeated rows share a shard and have places of their own.
    """
    return _unpacked(sharding.assign_shards(_packed(docs), shards=24), docs.columns, ["shard", "slot"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# A learned score has no SQL form; tests/llm/test_kernel_and_pipeline.py holds each stage against brute force on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read from there.

    A result is deleted once the next one is written; the last one stays for the reader.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
