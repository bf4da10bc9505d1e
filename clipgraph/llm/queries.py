"""Queries of the operators: thin readers of one table each, with their SQL in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgraph.llm import (
    decontaminate, langid, mixing, pages, pieces, pii, resample, runs, sharding, simhash, sql, tokencount, toxicity, weighted,
)
from clipgraph.llm.common import table

#: Vocabulary of public byte pieces, one a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Merge-type vocabulary with byte pieces.
MERGES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_sharding", sql.SHARDING)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, shards=24).drop("text")


@query("op8_mixing", sql.MIXING)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, entropy=0.95, repetition=4.0).drop("text")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.edited_likeness(table(spark, sf_dir, "documents"))


@query("op10_decontamination", sql.DECONTAMINATION)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=10).drop("text")


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learn(apart.filter("not held_out"), "text", "lang")
    return langid.predict(apart.drop("lang"), model).drop("text")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~langid.held_out(F.col("doc_id")))
    model = toxicity.learn(docs, labels)
    return toxicity.score(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), model, threshold=0.7).drop("text")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op11_importance_resampling", sql.RESAMPLING)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample.resample(docs, target, percent=25, least_words=20, longest=2, buckets=10_000, seed=7)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.detect(docs, least=24, repeats=3)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.floor(F.col("length") * 1000 / F.col("period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", listed).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MERGES) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, model, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
