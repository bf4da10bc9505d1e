"""Resampling, periodic runs and pieces of a merge-type vocabulary."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from clipgraph.llm import pieces, pii, resample, runs
from clipgraph.llm.queries import MERGES, QUERIES
from compare import differences

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TEXTS = [(1, "a b"), (1, "a b"), (1, None), (2, ""), (3, " \n\t "), (None, "x " * 30), (None, None), (4, "x" * 30_000), (5, "the cat " * 9000),
         (6, "\U0001f600 é idiot ▁ \0 <s> "), (7, "one two three four five " * 5)]
CLASHES = ["ids", "N_TOKENS", "decoded", "runs", "start", "length", "period", "score", "rank", "weight", "bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("own") for c in CLASHES})


# target-distribution resampling

def test_resampling_against_sql(spark):
    assert differences("op11_importance_resampling", spark, MEDIUM) == ""


def test_radix_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, 7, rng.randrange(-(10**6), 10**6)]), rng.choice([None, 0, 1, 2**40, -5]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(7)
    ranked = resample.radix_ranks(df, [df.a, df.b, df.c], digit_bits=5, block=200)
    got = [tuple(r[:3]) for r in sorted(ranked.collect(), key=lambda r: r["__rank"])]
    last = lambda v: (v is None, v or 0)
    assert got == sorted(rows, key=lambda r: tuple(map(last, r)))
    assert sorted(r["__rank"] for r in ranked.collect()) == list(range(1, 5001))
    same = resample.radix_ranks(df.limit(300).selectExpr("1 as a"), [F.col("a")], block=50)
    assert sorted(r["__rank"] for r in same.collect()) == list(range(1, 301))
    assert resample.radix_ranks(df.limit(0), [df.a]).collect() == []


def brute_resample(docs, target, percent, least):
    def features(t):
        w = resample.words_of(t)
        return w, w + [a + b" " + b for a, b in itertools.pairwise(w)]

    s, t = ([0] * 10_000 for _ in range(2))
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                counts[zlib.crc32(f) % 10_000] += 1
    rows = []
    for k, x in docs:
        w, fs = features(x)
        g = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in (zlib.crc32(f) % 10_000 for f in fs)]
        weight = math.floor(sum(g) / len(g)) if g else 0
        h = int(hashlib.sha256(f"7:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn):] + [r for r in rows if r[4] < least]], key=repr)


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_resampling_of_odd_rows(spark, docs, percent):
    target = spark.createDataFrame([("the cat sat",), (None,), ("",)], "text string")
    got = resample.resample(docs, target, percent=percent, least_words=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(TEXTS, ["the cat sat", None, ""], percent, 2)
    assert resample.resample(docs.limit(0), target).collect() == []
    assert resample.resample(docs, target.limit(0)).count() == len(TEXTS)


# periodic runs

def brute_runs(w, least=24, repeats=3):
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                out.setdefault((i, j + q), q)  # an equal stretch of a smaller period comes first
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "repeats"), [(24, 3), (6, 4), (1, 3)])
def test_runs_of_random_words(least, repeats):
    rng = random.Random(5)
    for _ in range(400):
        w = []
        while len(w) < rng.randrange(5, 250):
            unit = rng.choices("abcdefghij"[: rng.randrange(1, 10)], k=rng.randrange(1, 20))
            w += (unit * 9)[: rng.randrange(len(unit) * 9)] if rng.random() < 0.6 else unit
        assert runs.find_runs([w, [], w[3:]], least, repeats) == [brute_runs(w, least, repeats), [], brute_runs(w[3:], least, repeats)]


def test_runs_of_the_table(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for key, text in texts:
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(key).encode())
        if n and h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if n > 4000:
            continue  # too slow for the plain form
        found, r = brute_runs(w), rows[key]
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3) and r["n_runs"] == len(found)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()


def test_runs_of_odd_rows(docs):
    got = runs.detect(docs.drop("doc_id")).collect()
    assert len(got) == len(TEXTS) and all(r["score"] == "own" and r["collapsed"] is not None and r["n_runs"] == len(r["runs"]) for r in got)
    by = sorted((r["n_runs"], r["start"], r["length"], r["period"]) for r in got if r["n_runs"])
    assert by == [(1, 0, 25, 5), (1, 0, 30, 1), (1, 0, 18_000, 2)]
    assert runs.detect(docs.limit(0)).collect() == []
    planted = runs.with_repeats(docs)
    assert planted.columns == docs.columns and planted.filter("text is null").count() == 2


def test_equally_strong_runs():
    unit = [*"abcdefgh"]
    words = unit * 3 + ["-"] + [*"ABCDEFGH"] * 3
    found = runs.find_runs([words])[0]
    assert found == [(0, 24, 8), (25, 24, 8)] and runs.strongest(found) == (0, 24, 8)
    assert runs.collapse(words, found) == [*unit, "-", *"ABCDEFGH"]


def test_long_texts_of_runs():
    rng = random.Random(6)
    unit = [str(rng.randrange(50_000)) for _ in range(50_000)]
    assert runs.find_runs([(unit * 4)[:180_000]])[0] == [(0, 180_000, 50_000)]
    assert runs.find_runs([["a"] * 100_000])[0] == [(0, 100_000, 1)]


# pieces

def test_pieces_beside_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MERGES), pieces.read_model(MERGES)
    rng = random.Random(7)
    letters = "abc the AB 0 1 \n\t  ▁▁é́漢字😀<>/s<s></s><unk><0x0A>\0 идиот."
    known = {}
    for k in range(4000):
        text = "".join(rng.choices(letters, k=rng.randrange(120 if k % 3 else 20)))
        want = library.encode(text, add_bos=True, add_eos=True)
        (packed,) = own.encode([text], known)
        assert packed == np.array(want, "<u4").tobytes() and own.decode(packed) == library.decode(want)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32_000), 28705, 259, 13, 0, 1, 2]) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_pieces_of_the_tables(spark):
    table = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert pieces.disagreements(table, MERGES).count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=MERGES)
    rows = {r["doc_id"]: r for r in QUERIES["op13_sentencepiece"](spark, SMALL).collect()}
    for key, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(rows[key])[1:] == want


def test_pieces_of_odd_rows(docs):
    got = pieces.decode(pieces.encode(docs, MERGES), MERGES)
    assert dict(got.dtypes)["ids"] == "binary" and [c.lower() for c in got.columns].count("n_tokens") == 1
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in rows)
    assert all(r["n_tokens"] == 2 for r in rows if not r["text"])
    assert pieces.disagreements(docs, MERGES).count() == 0
    assert pieces.encode(docs.limit(0), MERGES).collect() == []
    once = pieces.encode(docs, MERGES, decoded="decoded")
    assert sorted((r["ids"], r["decoded"]) for r in once.collect()) == sorted((r["ids"], r["decoded"]) for r in rows)


def test_long_unbroken_text():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MERGES), pieces.read_model(MERGES)
    for text in ("ab" * 100_000, "漢字" * 50_000, " " * 100_000):
        assert own.encode([text])[0] == np.array(library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(b"")


def test_pii_learns_from_every_candidate(spark):
    """40,000 alike candidates that are no personal data and 300 that are: each counts, none is drawn."""
    rows = spark.range(40_300).select(
        F.lit(0).cast("long").alias("__t"), F.col("id").alias("__h"), F.lit("email").alias("kind"), F.lit(0).cast("long").alias("start"),
        F.lit(5).cast("long").alias("end"), (F.col("id") < 300).cast("double").alias("label"),
        *[F.when((F.col("id") < 300) & F.lit(f == "length"), 9.0).otherwise(F.lit(1.0)).alias(f) for f in pii.FEATURES])
    seen = []
    real = pii.stored
    pii.stored = lambda df: seen.append(real(df)) or seen[-1]
    try:
        model, limits = pii.learn(rows)
    finally:
        pii.stored = real
    table = seen[-1]
    assert table.count() == 4 and table.agg(F.sum("weight")).first()[0] == 40_300
    assert limits["email"] > 0.5 and model is not None
