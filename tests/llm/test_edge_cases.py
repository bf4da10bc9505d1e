"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest

from clipgraph.llm import decontaminate, langid, mixing, pages, pii, sharding, simhash, tokencount, toxicity, weighted
from clipgraph.llm.queries import VOCABULARY

LONG = "the cat sat on a mat and looked " * 4000
ROWS = [
    (1, "The cat sat on the mat.", "en", "a", 1), (1, "The cat sat on the mat.", "en", "a", 1), (2, None, None, None, None),
    (3, "", "en", None, 0), (4, " \n\t ", None, "b", 3), (None, "Die Katze ist auf der Matte", "de", "b", 5), (5, LONG, "en", "a", 9),
    (6, "x" * 70_000, "en", "c", 7), (7, "идиот мир кот", "ru", "c", 2), (None, None, None, None, None),
    (8, "mail a@b.co or 10.0.0.1, \U0001f600 +1 (212) 555-1234", "en", "a", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "shard", "SLOT", "score", "fp", "fingerprint", "weight", "epoch", "tokens", "n_hit", "lang_pred", "spans", "label", "item"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in CLASHES})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "cat sat on a mat and looked the cat sat on a mat"), (2, None), (3, ""), (None, "Katze ist"), (4, "?!")],
                                 "item_id long, text string")


def model():
    return langid.Model([("en", "word", "the", 5), ("en", "script", "Latin", 50), ("en", "letter", "^^t", 5),
                         ("ru", "word", "мир", 5), ("ru", "script", "Cyrillic", 50), ("ru", "letter", "^^м", 5)])


def operators(docs, benchmark):
    tox = toxicity.fit([(1, ["idiot", "cat"]), (0, ["the", "cat", "mat"])])
    return {
        "shards": (sharding.assign_shards(docs, shards=5), ["shard", "slot", "size", "text_crc32"]),
        "tokens": (tokencount.count_tokens(docs, VOCABULARY), ["n_words", "n_tokens", "longest"]),
        "simhash": (simhash.near_duplicates(docs), ["fingerprint"]),
        "toxicity": (toxicity.score(docs, tox), ["score", "predicted"]),
        "language": (langid.predict(docs, model()), ["lang_pred", "score"]),
        "weighted": (weighted.edited_likeness(docs), ["n_chars", "near_edited", "near_next"]),
        "pii": (pii.personal_data(docs), ["n_email", "base_sha256", "spans"]),
        "decontamination": (decontaminate.contamination(docs, benchmark), ["n_words", "n_hit", "contaminated"]),
    }


def test_one_row_for_each(docs, benchmark):
    for name, (out, filled) in operators(docs, benchmark).items():
        rows = out.collect()
        assert len(rows) == len(ROWS), name
        assert not [r for r in rows for c in filled if r[c] is None], name


def test_empty_tables(docs, benchmark):
    for name, (out, _) in operators(docs.limit(0), benchmark.limit(0)).items():
        assert out.collect() == [], name
    assert mixing.mix(docs.limit(0)).collect() == []
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_clashing_names_give_way_or_stay(docs, benchmark):
    out = sharding.assign_shards(docs, shards=5)
    assert dict(out.dtypes)["shard"] == "int" and [c.lower() for c in out.columns].count("slot") == 1
    assert out.filter("score <> 'own'").isEmpty()
    mixed = mixing.mix(docs)
    assert dict(mixed.dtypes)["weight"] == "double" and mixed.filter("shard <> 'own'").isEmpty()
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert decontaminate.contamination(docs, benchmark).filter("item <> 'own'").isEmpty()


def test_mixing_keeps_every_row(docs):
    out = mixing.mix(docs, repetition=3.0)
    assert out.filter("epoch = 0").count() == len(ROWS)
    assert {r["source"] for r in out.collect()} == {"a", "b", "c", None}


def test_near_copies(docs):
    kept = simhash.drop_near_copies(docs).select("doc_id", "text").collect()
    assert sum(r["text"] == "The cat sat on the mat." for r in kept) == 1
    assert sum(r["text"] is None or not r["text"].strip() for r in kept) == 4  # never copies
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_languages(docs):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model()).filter("doc_id is not null").collect()}
    assert got[2] == got[3] == got[4] == "und" and got[7] == "ru" and got[1] == "en"
    assert langid.predict(docs, langid.Model([])).filter("lang_pred <> 'und'").isEmpty()
    other = docs.limit(1).selectExpr("explode(array('καλημέρα κόσμε', '漢字', 'the καλημέρα')) as text")
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(other, model()).collect()] == [("en", 0.0), ("en", 0.0), ("en", 1.0)]


def test_models_without_examples(spark, docs):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is None
    assert toxicity.score(docs, None).filter("score <> 0 or predicted <> 0").isEmpty()
    assert langid.learn(docs.filter("lang is null"), "text", "lang").langs == []


def test_decontamination_of_odd_items(docs, benchmark):
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark).filter("doc_id = 5 or doc_id = 1").collect()}
    assert got[5]["contaminated"] and not got[1]["contaminated"]
    german = decontaminate.contamination(docs, benchmark).filter("text like 'Die%'").first()
    assert german["n_hit"] == 2 and german["n_items"] == 0  # an item without an id


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "a" * 50_000), (3, "u", "<p>" + "a" * 50_000), (None, "u", "<script>x"), (4, "u", "<a <b> c")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "katze ist auf")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, folder)
            got = out.collect()
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert (at < 4) == (len(out.columns) == len(docs.columns))
            assert bool(got) == (rows is docs)
