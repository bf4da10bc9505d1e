"""Languages of mixed texts: script ranges, per-word scores, and Viterbi over the words.

The script of a word, from ranges of code points, leaves the languages written in it. Each of them
scores the word by a mixture of its word frequencies and of a letter model (each letter after the
two before it). Viterbi then finds the best sequence of languages, where each change of language
costs a penalty, so that single odd words do not break a span.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: first code point of a range, and its script
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0B80, "Tamil"), (0x0E00, "Thai"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C60, "Latin"), (0x3040, "Kana"), (0x3400, "Han"), (0xAC00, "Hangul"),
    (0xF900, "Han"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x20000, "Han"),
)
_FIRST = [a for a, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")
#: A script belongs to a language if it has at least this share of its letters.
SCRIPT_SHARE = 0.05
#: Words whose scores a task remembers before it starts anew.
REMEMBERED = 200_000


def script(letter: str) -> str:
    i = bisect_right(_FIRST, ord(letter)) - 1
    return SCRIPTS[i][1] if i >= 0 else "other"


def letters_of(text: str | None) -> list[str]:
    """Words: runs of letters, in lower case."""
    return WORD.findall((text or "").lower())


class Model:
    """Counts of words and of letters after two letters, for each language."""

    def __init__(self, counts: Iterable[tuple[str, str, str, int]]):
        """``counts``: (language, kind, item, count) of kind ``word``, ``letter`` or ``script``."""
        rows = list(counts)
        self.langs = sorted({r[0] for r in rows})
        n = len(self.langs)
        place = {lang: i for i, lang in enumerate(self.langs)}
        words: dict[str, list[int]] = {}
        grams: dict[str, list[int]] = {}
        scripts = [Counter() for _ in range(n)]
        for lang, kind, item, count in rows:
            if kind == "script":
                scripts[place[lang]][item] += count
            else:
                (words if kind == "word" else grams).setdefault(item, [0] * n)[place[lang]] += count
        totals = [sum(c[i] for c in words.values()) for i in range(n)]
        self.word = {w: tuple(0.5 * c[i] / max(1, totals[i]) for i in range(n)) for w, c in words.items()}
        contexts: dict[str, list[int]] = {}
        for g, c in grams.items():
            under = contexts.setdefault(g[:2], [0] * n)
            for i in range(n):
                under[i] += c[i]
        size = len({g[2] for g in grams}) + 1
        self.gram = {g: tuple(math.log((c[i] + 0.1) / (contexts[g[:2]][i] + 0.1 * size)) for i in range(n)) for g, c in grams.items()}
        self.context = {c: tuple(math.log(0.1 / (v[i] + 0.1 * size)) for i in range(n)) for c, v in contexts.items()}
        self.unknown = (math.log(1 / max(1, size)),) * n
        self.candidates = {}
        for s in {s for c in scripts for s in c}:
            fits = tuple(c[s] >= SCRIPT_SHARE * max(1, sum(c.values())) for c in scripts)
            if any(fits):
                self.candidates[s] = fits

    def scores(self, word: str) -> tuple[int, tuple[float, ...]]:
        """Best language of a word, and the log scores less the best one; -1 if its script is no language's."""
        fits = self.candidates.get(script(word[0]))
        if fits is None:
            return -1, ()
        n = len(self.langs)
        total = [0.0] * n
        padded = "^^" + word + "$"
        for i in range(len(padded) - 2):
            g = padded[i : i + 3]
            p = self.gram.get(g) or self.context.get(g[:2]) or self.unknown
            for k in range(n):
                total[k] += p[k]
        seen = self.word.get(word)
        for k in range(n):
            if not fits[k]:
                total[k] = -1e6
            elif seen is not None and seen[k] > 0:
                total[k] = math.log(seen[k] + 0.5 * math.exp(max(total[k], -700.0)))
            else:
                total[k] -= math.log(2)
        best = max(range(n), key=total.__getitem__)
        return best, tuple(max(x - total[best], -30.0) if fits[k] else -60.0 for k, x in enumerate(total))

    def path(self, scored: list[tuple[int, tuple[float, ...]]], penalty: float) -> list[tuple[int, int]]:
        """Best spans: (first word, language), in order.

        While one language leads all others by the penalty, words that fit it best change nothing:
        the others can only be entered anew from it.
        """
        n = len(self.langs)
        value = [0.0] * n  # less the best one
        start: list[tuple] = [(0, k, None) for k in range(n)]
        best, settled = 0, False
        first = True
        for t, (own, score) in enumerate(scored):
            if own < 0 or (settled and own == best):
                continue
            if settled:
                for k in range(n):
                    if k != best:
                        value[k] = -penalty
                        start[k] = (t, k, start[best])
            elif not first:
                for k in range(n):
                    if value[k] < -penalty:
                        value[k] = -penalty
                        start[k] = (t, k, start[best])
            first = False
            for k in range(n):
                value[k] += score[k]
            best = max(range(n), key=value.__getitem__)
            top = value[best]
            settled = True
            for k in range(n):
                value[k] -= top
                if k != best and value[k] > -penalty:
                    settled = False
        spans = []
        at = start[best]
        while at is not None:
            spans.append((at[0], at[1]))
            at = at[2]
        spans.reverse()
        # a span may begin before the first word of the text only at 0; equal neighbours join
        joined: list[tuple[int, int]] = []
        for s in spans:
            if not joined or joined[-1][1] != s[1]:
                joined.append(s)
        return joined

    def label(self, text: str | None, known: dict, penalty: float) -> tuple[str, float, str]:
        """Language of most letters, its share of the letters, and the spans as language:start:end."""
        body = text or ""
        words = letters_of(body)
        if not words or not self.langs:
            return "und", 0.0, ""
        scored = []
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = self.scores(w)
            scored.append(s)
        spans = self.path(scored, penalty)
        if all(own < 0 for own, _ in scored):  # no script of a learned language: a name is given, but nothing speaks for it
            return self.langs[spans[0][1]], 0.0, f"{self.langs[spans[0][1]]}:0:{len(body)}"
        if len(spans) == 1:
            return self.langs[spans[0][1]], 1.0, f"{self.langs[spans[0][1]]}:0:{len(body)}"
        share, ends = [0] * len(self.langs), [s[0] for s in spans[1:]] + [len(words)]
        for (a, k), b in zip(spans, ends, strict=True):
            share[k] += sum(map(len, words[a:b]))
        low = body.lower()
        starts = [m.start() for m in WORD.finditer(low if len(low) == len(body) else body)]
        marks = [0] + [starts[min(a, len(starts) - 1)] for a, _ in spans[1:]] + [len(body)]
        shown = ",".join(f"{self.langs[k]}:{marks[i]}:{marks[i + 1]}" for i, (_, k) in enumerate(spans))
        best = max(range(len(share)), key=lambda k: (share[k], -k))
        return self.langs[best], share[best] / sum(share), shown


def learn(labelled: DataFrame, text: str, lang: str, documents: int = 2000, words: int = 20_000, grams: int = 30_000) -> Model:
    """Model from labelled texts; null labels are left out.

    About ``documents`` texts of each language are read whole, chosen by a hash of the text;
    the most frequent ``words`` words and ``grams`` letter triples of each language are kept, so the
    model has a fixed size for each language.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([])
    # a bounded number of texts per language: those whose hash is below the language's share
    bound = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        bound = F.when(F.col("lang") == name, F.lit(min(1.0, documents / n))).otherwise(bound)
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < bound * 1_000_000)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for frame in frames:
            for name, body in zip(frame["lang"], frame["text"], strict=True):
                found = Counter(letters_of(body))
                for w, c in found.items():
                    tally[name, "word", w] += c
                    tally[name, "script", script(w[0])] += c * len(w)
                    padded = "^^" + w + "$"
                    for i in range(len(padded) - 2):
                        tally[name, "letter", padded[i : i + 3]] += c
            if len(tally) > 500_000:
                yield _table(tally)
                tally.clear()
        if tally:
            yield _table(tally)

    counts = chosen.mapInPandas(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    kept = []
    for name in sizes:
        for kind, most in (("word", words), ("letter", grams), ("script", 100)):
            part = counts.filter((F.col("lang") == name) & (F.col("kind") == kind)).orderBy(F.desc("n"), "item").limit(most)
            kept += [(r["lang"], r["kind"], r["item"], r["n"]) for r in part.collect()]
    counts.unpersist()
    return Model(kept)


def _table(tally: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, n) for k, n in tally.items()], columns=["lang", "kind", "item", "n"])


def predict(df: DataFrame, model: Model, text: str = "text", penalty: float = 8.0) -> DataFrame:
    """``df`` with lang_pred, score and lang_spans.

    lang_pred has most letters of the text, score is its share of the letters, and lang_spans
    lists the spans as language:start:end, in code points.

    * Null text, or no letter: ``und``, score 0, no spans. Words in a script of no learned
      language go with their neighbours; a text of nothing else has score 0. A model without languages: ``und``.
    * Ties: the language first in the alphabet. Repeated rows are labelled each. Empty table: no rows.
    * Columns named like a result are replaced.

    A row at a time, without a shuffle; the model has a fixed size and is sent to every task.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = {"lang_pred", "score", "lang_spans"} - {text.lower()}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])
    labelled = base.withColumn("__l", _labels(F.col(f"`{text}`"), shared, penalty))
    return labelled.withColumns({
        "lang_pred": F.col("__l.lang"), "score": F.col("__l.share"), "lang_spans": F.col("__l.spans")}).drop("__l")


def _labels(text: Column, shared, penalty: float) -> Column:
    @F.pandas_udf("lang string, share double, spans string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for batch in batches:
            rows = []
            for body in batch:
                rows.append(model.label(body, known, penalty))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.DataFrame(rows, columns=["lang", "share", "spans"])

    return of(text)


def held_out(key: Column) -> Column:
    """Rows kept from learning: CRC-32 of the key as text leaves 1 when divided by 3. Null keys are learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
