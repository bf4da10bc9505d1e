"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights. For each of the samples, a word draws two
gamma variables and a uniform one, from its hash alone; they place a grid on the log of the weight
and a value on each grid cell. The word and cell with the smallest value are the sample. Two
documents have the same sample with a probability equal to their generalised Jaccard similarity,
the sum of the smaller over the sum of the larger weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a fingerprint; each is kept as 16 bits.
SAMPLES = 64
#: Words whose draws a task remembers before it starts anew (1 KB each).
REMEMBERED = 100_000
#: Rows of one range of the order, about, and the most ranges.
RANGE_ROWS = 8_000
MOST_RANGES = 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """The draws of words, one row a word, kept from batch to batch."""

    def __init__(self) -> None:
        self.row: dict[bytes, int] = {}
        self.hash = np.empty(REMEMBERED, np.uint64)
        self.r, self.beta, self.logc, self.single = np.empty((4, REMEMBERED, SAMPLES), np.float32)

    def learn(self, words: Iterable[bytes]) -> None:
        fresh = list({w for w in words if w not in self.row})
        if len(self.row) + len(fresh) > len(self.hash):
            self.row.clear()
            fresh = list(set(words))
            if len(fresh) > len(self.hash):
                self.hash = np.empty(len(fresh), np.uint64)
                self.r, self.beta, self.logc, self.single = np.empty((4, len(fresh), SAMPLES), np.float32)
        if not fresh:
            return
        first, last = len(self.row), len(self.row) + len(fresh)
        self.row.update(zip(fresh, range(first, last), strict=True))
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in fresh), np.uint64, len(fresh))
        salt = _mix(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, SAMPLES)
        low, high = np.uint64(0xFFFFFFFF), np.uint64(32)

        def uniform(part: np.ndarray) -> np.ndarray:
            return (part.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)

        def gamma(i: int) -> np.ndarray:  # shape 2: the sum of two exponentials
            x = _mix(h[:, None] + salt[i])
            return -np.log(uniform(x & low)) - np.log(uniform(x >> high))

        r, logc = np.maximum(gamma(0), np.float32(1e-6)), np.log(np.maximum(gamma(1), np.float32(1e-30)))
        beta = np.minimum(uniform(_mix(h[:, None] + salt[2]) >> high), np.float32(1 - 2.0**-24))
        self.hash[first:last], self.r[first:last], self.logc[first:last], self.beta[first:last] = h, r, logc, beta
        self.single[first:last] = logc - r * (1 - beta)


def fingerprint_batch(texts: Iterable[str | None], draws: Draws, rows: int = 64) -> np.ndarray:
    """(documents, SAMPLES) 16-bit samples; a document without words has all zeros, no other has a zero.

    The words of ``rows`` documents are held at a time.
    """
    texts = list(texts)
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    for at in range(0, len(texts), rows):
        part = [Counter((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts[at : at + rows]]
        draws.learn([w for c in part for w in c])
        sizes = np.array([len(c) for c in part])
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        word = np.fromiter((draws.row[w] for c in part for w in c), np.int64, int(sizes.sum()))
        weight = np.fromiter((n for c in part for n in c.values()), np.float32, len(word))
        value = draws.single[word]  # of weight 1, whose cell is 0
        many = np.flatnonzero(weight != 1)
        r, beta = draws.r[word[many]], draws.beta[word[many]]
        cell = np.floor(np.log(weight[many])[:, None] / r + beta)
        value[many] = draws.logc[word[many]] - r * (cell - beta + 1)
        place = np.zeros(len(word), np.int64)
        place[many] = np.arange(1, len(many) + 1)
        starts = (np.cumsum(sizes) - sizes)[full]
        least = np.repeat(np.minimum.reduceat(value, starts, axis=0), sizes[full], axis=0)
        at_row, at_sample = np.nonzero(value == least)
        of_cell = np.concatenate((np.zeros((1, SAMPLES)), cell))[place[at_row], at_sample].astype(np.int64).astype(np.uint64)
        sample = _mix(draws.hash[word[at_row]] + np.uint64(7919) * of_cell) >> np.uint64(48)
        # where rounding makes two words equal, the smaller sample is taken, whatever the order of words
        best = np.full((len(full), SAMPLES), 0xFFFF, np.uint64)
        np.minimum.at(best, (np.repeat(np.arange(len(full)), sizes[full])[at_row], at_sample), sample)
        out[at + full] = np.maximum(best.astype(np.uint16), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def _packed(samples: np.ndarray) -> pd.Series:
    return pd.Series([row.tobytes() for row in samples.astype(">u2")], dtype=object)


def _unpacked(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), ">u2").reshape(-1, SAMPLES)


def fingerprint_column(text: Column | str) -> Column:
    """Packed samples of each text."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        draws = Draws()
        for batch in batches:
            yield _packed(fingerprint_batch(batch, draws))

    return of(text)


def _compared(edited: str, own: str, following: str) -> Column:
    """Packed samples of the edited text, and how like they and the following text's are to the own ones."""

    @F.pandas_udf("fp binary, near_edited double, near_next double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        draws = Draws()
        for texts, mine, other in batches:
            fp, mine = fingerprint_batch(texts, draws), _unpacked(mine)
            yield pd.DataFrame({"fp": _packed(fp), "near_edited": likeness(mine, fp), "near_next": likeness(mine, _unpacked(other))})

    return of(edited, own, following)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) for every row: 64 samples of 16 bits, in hexadecimal.

    Words are runs of anything but ASCII white space, with A-Z in lower case, weighted by their
    counts. Null, empty and blank texts have the fingerprint 0. Repeated rows are kept.
    """
    return df.select(F.col(f"`{key}`"), F.lower(F.hex(fingerprint_column(F.col(f"`{text}`")))).alias("fingerprint"))


def _range_of(value: Column, cuts: list) -> Column:
    """Number of cuts at or below ``value``, by bisection; 0 for null."""
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.lit(c) for c in cuts])

    def halve(state, _):
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.element_at(points, middle + 1) <= value
        return F.when(state["lo"] < state["hi"], F.struct(
            F.when(below, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(below, state["hi"]).otherwise(middle).alias("hi"))).otherwise(state)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, halve, lambda s: s["lo"])
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def in_ranges(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the range of each row's key, and once more the first row of each range, lent to the range before it.

    There are at most 10,000 ranges, cut at approximate quantiles of the key.
    """
    n = df.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts: list = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = df.agg(F.percentile_approx(key, shares, 20 * ranges)).first()[0] or []
        cuts = sorted(set(found))
    placed = df.withColumn("__range", _range_of(F.col(key), cuts))
    # `first` of a range: its largest key; the range above it needs that row as its last row's next
    tops = placed.groupBy("__range").agg(F.max(key).alias("__top"))
    upward = Window.orderBy("__range")  # at most MOST_RANGES rows
    tops = tops.withColumn("__to", F.lead("__range").over(upward)).withColumn(
        "__to", F.coalesce("__to", F.min("__range").over(Window.orderBy(F.lit(1)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))))
    lent = placed.join(F.broadcast(tops), (F.col(key).eqNullSafe(F.col("__top"))) & (placed["__range"] == tops["__range"])).select(
        *[placed[c] for c in df.columns], F.col("__to").alias("__range"), F.lit(1).alias("__lent"))
    return placed.withColumn("__lent", F.lit(0)).unionByName(lent)


def with_following(rows: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """Rows of ``in_ranges`` with ``next_<column>`` of the next row by descending ``key``; the last row's next is the first.

    One exchange, and no task holds more than a range. Null keys come last; rows of one key
    follow each other by ``tie``.
    """
    order = Window.partitionBy("__range").orderBy("__lent", F.col(key).desc_nulls_last(), tie)
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("__lent = 0").drop("__lent", "__range")


def edited_likeness(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of the text with its last third taken from the next document.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next
    document is the next smaller key, and for the smallest the largest; the edited text has the
    last floor(n_chars / 3) code points replaced by the first as many of the next text, or by all
    of it if it is shorter.

    * Null text: an empty text. Texts without words have fingerprint 0; two of them are alike
      (1.0), and such a one is unlike any other.
    * Null keys come last in the order. Repeated keys follow each other by the MD5 of the text.
    * A single row is its own next. Empty table: no rows. Other columns are not read.

    Text moves once, to the range of its key.
    """
    base = df.select(F.col(f"`{key}`").alias("__k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = in_ranges(base, "__k").withColumns({"__fp": fingerprint_column("__text"), "__md5": F.md5("__text")})
    ordered = with_following(rows, "__k", ["__text", "__fp"], "__md5")
    taken = F.floor(F.length("__text") / 3).cast("int")
    edited = ordered.select(
        "__k", F.length("__text").cast("long").alias("n_chars"), "__fp", "next___fp",
        F.concat(F.substring("__text", 1, F.length("__text") - taken), F.substring("next___text", F.lit(1), taken)).alias("__edited"))
    seen = edited.withColumns({"edited_sha256": F.sha2("__edited", 256), "__c": _compared("__edited", "__fp", "next___fp")})
    return seen.select(
        F.col("__k").alias(key), "n_chars", "edited_sha256", F.lower(F.hex("__fp")).alias("fingerprint"),
        F.lower(F.hex("__c.fp")).alias("edited_fingerprint"), "__c.near_edited", "__c.near_next")
