"""Drawing documents so that the drawn ones look like a target text: weights by hashed features, ranks by radix sort.

A document's features are its runs of one or two words, hashed into buckets. How much likelier a
bucket is in the target than in the corpus is one array; a document's weight is the mean of its
features' entries. Adding noise of the Gumbel kind to the weights and taking the highest scores draws without
replacement in proportion to the weights.

The scores are ranked by a distributed radix sort. Each pass takes one digit of the key, the least
significant first: rows are counted by (block, digit), running sums over (digit, block) say where
each such group starts, and a row moves to that place plus its number in the group, in the order of the pass
before. After the last pass a row's place is its rank.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import stored

#: Bits of a digit of the radix sort, and rows of a block: a pass counts rows by (block, digit).
DIGIT_BITS, BLOCK = 9, 1 << 13

# bytes of words as they are (A-Z in lower case), every other byte a space
_WORD_BYTES = bytes(
    b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def feature_hashes(words: list[bytes], longest: int) -> list[int]:
    """CRC-32 of every run of 1 to ``longest`` consecutive words, joined by one space; a longer run goes on from the shorter one's."""
    row = list(map(zlib.crc32, words))
    out = list(row)
    spaced = [b" " + w for w in words]
    for k in range(1, longest):
        row = list(map(zlib.crc32, spaced[k:], row))
        out += row
    return out


def bucket_counts(df: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket. Each task gives at most ``buckets`` rows, the driver gets ``buckets``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch["t"]:
                hashes = feature_hashes(words_of(t), longest)
                if hashes:
                    total += np.bincount(np.array(hashes, np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    got = df.select(F.col(f"`{text}`").alias("t")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in got.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target than in the corpus, one added to every count."""
    k = len(corpus)
    whole_corpus, whole_target = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([
        math.floor(1000 * math.log((float(t + 1) * whole_corpus) / (float(s + 1) * whole_target)))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def noise(key: str, seed: int) -> int:
    """Thousandths of Gumbel noise from the first 32 bits of a digest of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(df: DataFrame, gain: np.ndarray, key: str, text: str, longest: int, seed: int) -> DataFrame:
    """(key, n_words, n_features, weight, score) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long, score long")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        for keys, texts in batches:
            rows = []
            for k, t in zip(keys, texts, strict=True):
                words = words_of(t)
                hashes = feature_hashes(words, longest)
                weight = int(gain[np.array(hashes, np.int64) % len(gain)].sum()) // len(hashes) if hashes else 0
                rows.append((len(words), len(hashes), weight, weight + noise(k, seed)))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight", "score"])

    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    return df.select(F.col(f"`{key}`"), of(named, F.col(f"`{text}`")).alias("__s")).select(f"`{key}`", "__s.*")


def radix_ranks(df: DataFrame, order: list[Column], digit_bits: int = DIGIT_BITS, block: int = BLOCK) -> DataFrame:
    """``df`` with __rank (1, 2, 3...) by whole-number columns, the most significant first, nulls last in each.

    Each column counts from its least value, so it has as many digits as its range needs. Rows that
    are equal in all columns are ranked in any order. A pass moves each row once, to a group of one
    block and one digit, which holds at most ``block`` rows however often a digit occurs; the
    table of groups has at most 2^digit_bits rows for each block. The result of each pass is written, so that
    a repeated task finds the same rows in the same places.
    """
    digits = 1 << digit_bits
    names = [f"__k{i}" for i in range(len(order))]
    keyed = stored(df.withColumns(dict(zip(names, order, strict=True))))
    ends = keyed.agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{a}{n}") for n in names for a, f in (("low", F.min), ("high", F.max))]).first()
    keyed = keyed.withColumns({
        n: F.coalesce(F.col(n) - F.lit(ends[f"low{n}"] or 0), F.lit((ends[f"high{n}"] or 0) - (ends[f"low{n}"] or 0) + 1)) for n in names})
    # first places: those of the rows in the written files, whose partitions are apart by 2^33 places
    placed = keyed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__block", F.floor(F.col("__at") / block))
    for n in reversed(names):
        top = (ends[f"high{n}"] or 0) - (ends[f"low{n}"] or 0) + 1
        for shift in range(0, max(1, top.bit_length()), digit_bits):
            digit = F.shiftright(F.col(n), shift).bitwiseAND(digits - 1)
            placed = stored(_pass(placed.withColumn("__digit", digit), block))
    return placed.withColumn("__rank", F.col("__at") + 1).drop("__at", "__block", *names)


def _pass(df: DataFrame, block: int) -> DataFrame:
    """One stable counting sort by __digit: rows with their new place __at and its __block."""
    counts = df.groupBy("__block", "__digit").agg(F.count(F.lit(1)).alias("__n"))
    # places before a group: all rows of smaller digits, and those of its digit in the blocks before
    smaller = Window.orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
    of_digit = counts.groupBy("__digit").agg(F.sum("__n").alias("__all"))
    base = of_digit.select("__digit", F.coalesce(F.sum("__all").over(smaller), F.lit(0)).alias("__base"))  # one row a digit
    earlier = Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(F.broadcast(base), "__digit")
    starts = groups.select("__block", "__digit", (F.col("__base") + F.col("__before")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__block", "__digit").orderBy("__at")) - 1
    moved = df.withColumn("__in", inside).join(starts, ["__block", "__digit"])
    return moved.withColumn("__at", F.col("__start") + F.col("__in")).withColumn("__block", F.floor(F.col("__at") / block)).drop(
        "__digit", "__in", "__start")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """(key, n_features, weight, score, rank) for every row of ``docs``; rank is null where the row isn't drawn.

    floor(percent * N / 100) of the N rows with at least ``least_words`` words are drawn: those with
    the highest scores, of equal scores the smallest keys (a whole number), null keys last.

    * Null, empty and wordless texts: no features, weight 0, never drawn if ``least_words`` is above 0.
    * Rows with one key have one noise; a null key's is that of the text "null". Repeated rows count
      and are drawn each; rows alike in score and key are ranked by n_features, and in any order where that is equal too.
    * Empty table: no rows. Empty target: weights from one added count in each bucket. Other columns aren't read.

    Two passes read the texts, one for the counts and one for the scores; neither shuffles them.
    The driver and every task hold arrays of ``buckets`` numbers.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = stored(score(docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")), gain, "__key", "__text", longest, seed))
    able = F.col("n_words") >= least_words
    n = scored.filter(able).count()
    ranked = radix_ranks(scored.filter(able), [-F.col("score"), F.col("__key").cast("long"), F.col("n_features")])
    drawn = F.when(F.col("__rank") <= percent * n // 100, F.col("__rank"))
    both = ranked.withColumn("rank", drawn).drop("__rank").unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("__key").alias(key), "n_features", "weight", "score", "rank")
