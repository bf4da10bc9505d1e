"""Periodic runs of words: the same few words over and over.

A run that counts has at least three periods, so each of its words stands in it three times or more.
Words that are rarer in the stretch at hand can be in no such run: they cut the stretch, and the
parts are counted anew until nothing changes. Only what is left is compared with itself at each lag.

At lag q a run of 3q words holds two neighbouring blocks of q words, cut at multiples of q, that are
equal. So a lag looks at n / q blocks and all lags together at n log n; words are compared one by
one only at the two ends of blocks that are equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import without

#: Words of texts that are taken apart side by side.
TOGETHER = 1 << 17

Run = tuple[int, int, int]  # start, length, period


def stretches(words: np.ndarray, bounds: np.ndarray, least: int, repeats: int) -> list[tuple[int, int]]:
    """(start, end) of what recursive splitting leaves of the stretches between neighbouring ``bounds``.

    All stretches are counted in the same round; a word number is rare where it stands fewer than
    ``repeats`` times in its stretch, and parts of fewer than ``least`` words go.
    """
    at = np.arange(len(words))
    stretch = np.searchsorted(bounds, at, side="right").astype(np.int64)
    while True:
        # parts: neighbouring positions of one stretch
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(stretch) != 0)]) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(at)])
        stretch = np.repeat(np.arange(len(first)), size)
        keep = np.repeat(size >= least, size)
        at, stretch = at[keep], stretch[keep]
        if not len(at):
            return []
        key = stretch << 32 | words[at]
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[where] >= repeats
        if often.all():
            first = np.flatnonzero(np.r_[True, np.diff(stretch) != 0])
            last = np.r_[first[1:], len(at)] - 1
            return list(zip(at[first].tolist(), (at[last] + 1).tolist(), strict=True))
        at, stretch = at[often], stretch[often]


def runs_within(w: np.ndarray, least: int, repeats: int) -> list[Run]:
    """All runs of ``w`` by lag: maximal stretches with smallest period q of at least max(least, repeats * q) words."""
    n = len(w)
    found: list[Run] = []
    names, width = w, 1  # equal names: equal blocks of ``width`` words from there on
    ends: set[tuple[int, int]] = set()
    cover = np.full(n, -1, np.int64)  # the last run found over each word
    for q in range(1, n // repeats + 1):
        if q >= 2 * width:
            pair = names[: n - 2 * width + 1].astype(np.int64) << 32 | names[width : n - width + 1]
            names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            width *= 2
        starts = np.arange(0, n - q + 1, q)
        head, tail = names[starts], names[starts + (q - width)]
        same = (head[1:] == head[:-1]) & (tail[1:] == tail[:-1])
        if not same.any():
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
        for a, b in zip((edge[::2] * q).tolist(), ((edge[1::2] + 1) * q).tolist(), strict=True):
            if cover[a] >= 0:
                s, k, p = found[cover[a]]
                if q % p == 0 and b <= s + k:
                    continue  # blocks of a run with a smaller period
            back = w[max(0, a - q) : a] != w[max(0, a - q) + q : a + q]
            start = a - (int(np.argmax(back[::-1])) if back.any() else len(back))
            ahead = w[b : b + q] != w[b - q : b - q + len(w[b : b + q])]
            end = b + (int(np.argmax(ahead)) if ahead.any() else len(ahead))
            if end - start >= max(least, repeats * q) and (start, end) not in ends:
                cover[start:end] = len(found)
                ends.add((start, end))
                found.append((start, end - start, q))
    return found


def find_runs(texts: list[list], least: int = 24, repeats: int = 3) -> list[list[Run]]:
    """The runs of each list of words, by start and then period."""
    out: list[list[Run]] = [[] for _ in texts]
    numbers: dict = {}
    sizes = [len(t) for t in texts]
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, sum(sizes))
    bounds = np.cumsum(sizes)
    for a, b in stretches(words, bounds, least, repeats):
        which = int(np.searchsorted(bounds, a, side="right"))
        before = int(bounds[which]) - sizes[which]
        own = np.unique(words[a:b], return_inverse=True)[1].astype(np.int64)
        out[which] += [(s + a - before, length, q) for s, length, q in runs_within(own, least, repeats)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period, compared exactly; the first of equal ones, then the smallest period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list, runs: list[Run]) -> list:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, q in runs:
        gone[start + q : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def _batches(texts: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    some, size = [], 0
    for words in texts:
        some.append(words)
        size += len(words)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def detect(df: DataFrame, text: str = "text", least: int = 24, repeats: int = 3) -> DataFrame:
    """``df`` with runs (array of start, length, period), n_runs, the strongest run's start, length, period, and collapsed.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch of words
    with smallest period q, of at least max(least, repeats * q) words, that no word beside it
    continues. Runs are listed by start, then period. ``collapsed`` is the text's words, joined by
    one space, less those that any run holds after its first period.

    * Null, empty and blank texts have no words: no runs, start, length and period null, collapsed empty.
    * Repeated rows are read each; of equally strong runs the first stands, then the one with the
      smallest period. Empty table: no rows. Columns named like a result are replaced.

    A text is read whole, by one task, in time n log n.
    """
    if repeats < 3:  # the blocks that the lags compare need three periods
        raise ValueError("a run has at least three periods")

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, collapsed string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _batches((t or "").encode("utf-8", "surrogatepass").split() for batch in batches for t in batch):
            rows = []
            for words, runs in zip(texts, find_runs(texts, least, repeats), strict=True):
                kept = b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")
                rows.append(([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], *(strongest(runs) or (None,) * 3), kept))
            out = pd.DataFrame(rows, columns=["runs", "start", "length", "period", "collapsed"])
            yield out.astype({"start": "Int64", "length": "Int64", "period": "Int64"})

    own = ["runs", "n_runs", "start", "length", "period", "collapsed"]
    return without(df, [c for c in own if c != text]).withColumn("__r", of(F.col(f"`{text}`"))).withColumns(
        {c: F.col(f"__r.{c}") for c in own if c != "n_runs"} | {"n_runs": F.size("__r.runs").cast("long")}).drop("__r")


def with_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` whose texts repeat their own words in every tenth row, as the key's checksum says.

    With h the checksum of the key as decimal text and g = h div 10: if h mod 10 is 0, each word from
    a = g mod n on becomes the word at a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Words are
    joined by one space then; other rows, rows without a key and texts without words stay as they are.
    """
    @F.pandas_udf("string")
    def repeated(hashes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_repeat(int(h) // 10, t) if h is not None and h == h and int(h) % 10 == 0 and t else t
                          for h, t in zip(hashes, texts, strict=True)], dtype=object)

    return df.withColumn(text, repeated(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.col(f"`{text}`")))


def _repeat(g: int, text: str) -> str:
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode("utf-8", "surrogatepass")
