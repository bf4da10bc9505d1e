"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares words by the letter triples they have in common as subsequences, each weighted
by a power of the stretch it covers, so that letters between those of an insult lower the match
without losing it. The Nyström method replaces the kernel by the kernel values to some landmark
words. A text is as toxic as its worst word; labels are given for texts, so learning picks, round by
round, the word of each toxic text that explains its label.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the subsequences.
ORDER = 3
#: Characters that have codes of their own: the ends of words have code 1, all others share code 0.
ALPHABET = 64
#: Longest stretch of a subsequence, with its ends.
SPAN = 8
#: Longest piece that the kernel sees; longer words are read in overlapping pieces.
PIECE = 16
#: Words whose scores a task remembers before it starts anew.
REMEMBERED = 400_000

_TRIM = re.compile(r"^[^\w]+|[^\w]+$")
_LETTERS = re.compile(r"[\W\d_]+")


def units(text: str | None) -> list[str]:
    """Words of a text in lower case, without marks at their ends.

    A word with marks or digits inside also counts without them, and three or more single letters
    in a row count as one word.
    """
    out: list[str] = []
    run: list[str] = []
    for raw in (text or "").lower().split():
        word = raw if raw.isalpha() else _TRIM.sub("", raw)
        if len(word) == 1:
            run.append(word)
            continue
        if run:
            if len(run) > 2:
                out.append("".join(run))
            run = []
        if len(word) > 2:
            out.append(word)
            if not word.isalpha():
                bare = _LETTERS.sub("", word)
                if len(bare) > 2:
                    out.append(bare)
    if len(run) > 2:
        out.append("".join(run))
    return out


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


class Kernel:
    """Weights of letter triples, for words of every length up to ``PIECE``."""

    def __init__(self, alphabet: str, decay: float):
        self.code = {c: i + 2 for i, c in enumerate(alphabet[: ALPHABET - 2])}
        self.places, self.weights = {}, {}  # by length of a word, whose two ends count as letters
        for n in range(PIECE + 1):
            triples = np.array([t for t in combinations(range(n + 2), ORDER) if t[-1] - t[0] < SPAN], np.int64).reshape(-1, ORDER)
            weight = decay ** (triples[:, -1] - triples[:, 0] + 1.0)
            # words of one length share a norm, which makes scores of different lengths comparable
            self.places[n], self.weights[n] = triples, (weight / np.sqrt(max((weight**2).sum(), 1e-30))).astype(np.float32)

    def codes(self, words: list[str]) -> np.ndarray:
        get = self.code.get
        return np.array([[1, *[get(c, 0) for c in w], 1] for w in words], np.int64)

    def triples(self, words: list[str]) -> np.ndarray:
        """Index of each letter triple of words of one length."""
        codes, at = self.codes(words), self.places[len(words[0])]
        return (codes[:, at[:, 0]] * ALPHABET + codes[:, at[:, 1]]) * ALPHABET + codes[:, at[:, 2]]

    def spread(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The triples that words have (one entry for each), and the words' weights over them."""
        found = [(self.triples([w])[0], self.weights[len(w)]) for w in words]
        used, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
        rows = np.zeros((len(words), len(used)), np.float32)
        np.add.at(rows, (np.repeat(np.arange(len(words)), [len(t) for t, _ in found]), at), np.concatenate([w for _, w in found]))
        return used, rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def apart(self, words: list[str], most: int) -> list[str]:
        """Up to ``most`` words: in order those that are not much like one taken before, then the others in order."""
        _, rows = self.spread(words)
        alike = rows @ rows.T
        taken: list[int] = []
        for i in range(len(words)):
            if not taken or alike[i, taken].max() < 0.5:
                taken.append(i)
        rest = sorted(set(range(len(words))) - set(taken[:most]))
        return [words[i] for i in (taken + rest)[:most]]

    def against(self, words: list[str], used: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Product of each word with each of ``rows`` over the triples ``used``; words under three letters have none."""
        out = np.zeros((len(words), len(rows)), np.float32)
        place = np.zeros(ALPHABET**ORDER, np.int32)
        place[used] = np.arange(1, len(used) + 1)
        turned = np.vstack([np.zeros((1, len(rows)), np.float32), rows.T])
        for n, part in _by_length(words, 2_000_000 // len(rows)):
            out[part] = self.weights[n] @ turned[place[self.triples([words[i] for i in part])]]
        return out / self.norms(words)[:, None]

    def norms(self, words: list[str]) -> np.ndarray:
        """Norm of each word against that of a word of its length without repeated triples: 1 or more."""
        out = np.ones(len(words), np.float32)
        for i, w in enumerate(words):
            if len(w) >= ORDER:
                _, at = np.unique(self.triples([w])[0], return_inverse=True)
                out[i] = max(1.0, float(np.sqrt((np.bincount(at, self.weights[len(w)]) ** 2).sum())))
        return out

    def weigh(self, words: list[str], table: np.ndarray, floor: float) -> np.ndarray:
        """Product of each word with one weight for every triple.

        The norm of a word is 1 or more, so only words that come above ``floor`` without it need theirs.
        """
        out = np.zeros(len(words), np.float32)
        for n, part in _by_length(words, 400_000):
            out[part] = table[self.triples([words[i] for i in part])] @ self.weights[n]
        high = np.flatnonzero(out > floor)
        out[high] = np.maximum(out[high] / self.norms([words[i] for i in high.tolist()]), floor)
        return out


def _by_length(words: list[str], size: int) -> Iterator[tuple[int, list[int]]]:
    """Places of words of one length, so many that their triples number about ``size``."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= ORDER:
            groups.setdefault(len(w), []).append(i)
    for n, members in groups.items():
        step = max(1, size // (25 * n))
        for a in range(0, len(members), step):
            yield n, members[a : a + step]


class Model:
    """Triple weights of the machine, and the curve from its margin to a probability."""

    def __init__(self, kernel: Kernel, used: np.ndarray, table: np.ndarray, bias: float, slope: float, shift: float):
        self.kernel, self.bias, self.slope, self.shift = kernel, bias, slope, shift
        self.table = np.zeros(ALPHABET**ORDER, np.float32)
        self.table[used] = table

    def margins(self, words: list[str]) -> np.ndarray:
        parts = [p for w in words for p in pieces(w)]
        found = self.kernel.weigh(parts, self.table, max(0.0, -0.2 - self.bias)) + self.bias
        sizes = np.array([len(pieces(w)) for w in words], np.int64)
        return np.maximum.reduceat(found, np.cumsum(sizes) - sizes) if len(words) else np.zeros(0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(margin, -2, 2) + self.shift, -500, 500)))

    def score(self, texts: Iterable[str | None], known: dict[str, float]) -> list[tuple[float, str]]:
        """(probability, worst word) of each text."""
        split = [units(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for words in split for w in words if w not in known})
        known.update(zip(fresh, self.margins(fresh).tolist(), strict=True))
        worst = [max(words, key=known.__getitem__) if words else "" for words in split]
        margin = np.array([known[w] if w else self.bias for w in worst])
        return list(zip(self.probability(margin).tolist(), worst, strict=True))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.7, rounds: int = 25) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    hold = np.eye(len(w)) * ridge
    hold[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) + hold, xa.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability, with the labels drawn in a little at both ends."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([np.clip(margin, -2, 2), np.ones(len(margin))])
    w = np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * v @ v)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step, size = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-3 * w), 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:  # shorter, until it helps
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _disturbed(words: list[str], rng: np.random.Generator, letters: str) -> list[str]:
    """Words with letters or marks put in between, or a letter doubled."""
    out = []
    for w in words:
        i = int(rng.integers(1, len(w)))
        out.append(w[:i] + letters[int(rng.integers(len(letters)))] + w[i:])
        out.append(w[:i] + w[i - 1] + w[i:])
        out.append("*".join(w)[:PIECE])
    return out


def fit(bags: Iterable[tuple[int, list[str]]], landmarks: int = 200, decay: float = 0.6, rounds: int = 3, witnesses: int | None = None,
        seed: int = 1) -> Model | None:
    """Machine from (label, words of a text) pairs; None if one of the labels is missing.

    Every word of a clean text is an example of a clean word. Words that ``witnesses`` toxic texts (a
    fiftieth of them, 3 to 12, if not given) or more and no clean text have are the first toxic
    examples. Toxic texts without such a word give, each round, their word with the largest margin
    if it is on the toxic side. Clean words that come too near are added as examples, too.
    """
    toxic: list[tuple[str, ...]] = []
    clean: list[tuple[str, ...]] = []
    once: dict[str, str] = {}  # texts share their words
    for label, words in bags:
        bag = tuple(sorted({once.setdefault(p, p) for w in words for p in pieces(w)}))
        if label == 0:
            clean.append(bag)
        elif bag:
            toxic.append(bag)
    del once
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    clean_count = Counter(p for b in clean for p in b)
    toxic_count = Counter(p for b in toxic for p in b)
    letters = Counter(c for p in (clean_count + toxic_count) for c in p)
    alphabet = "".join(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - 2])
    kernel = Kernel(alphabet, decay)
    telling = {p: n for p, n in toxic_count.items() if not clean_count[p]}
    toxic = [b for b in (tuple(p for p in b if len(p) >= ORDER) for b in toxic) if b]
    if not toxic:
        return None
    witnesses = witnesses or max(3, min(12, len(toxic) // 50))
    # words that many toxic texts and no clean one have explain their texts; other texts are explained later, by likeness
    sure = [p for b in toxic for p in b if telling.get(p, 0) >= witnesses]
    open_bags = [b for b in toxic if not any(telling.get(p, 0) >= witnesses for p in b)]
    picked = sure or [p for p in (max(b, key=lambda p: (telling.get(p, 0), p)) for b in toxic) if telling.get(p, 0) > 1]
    picked = picked or [p for b in toxic for p in b if p in telling]
    if not picked:
        return None
    clean_words = sorted(clean_count, key=lambda p: (-clean_count[p], p))
    plain = clean_words[:4000] + [clean_words[i] for i in sorted(rng.permutation(np.arange(4000, max(4000, len(clean_words))))[:6000].tolist())]
    spelled = "".join(c for c in alphabet if c.isalpha())[:26] + ".*-_"
    model = None
    for turn in range(rounds):
        tally = Counter(picked)
        good = sorted(tally, key=lambda p: (-tally[p], p))
        marks = kernel.apart(good[:500], landmarks * 2 // 3)
        marks += [plain[i] for i in sorted(rng.permutation(min(len(plain), 4000))[: landmarks - len(marks)].tolist())]
        used, tables = kernel.spread(marks)
        gram = tables @ tables.T
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        keep = values > 1e-4 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        extra = _disturbed([p for p in good if ORDER <= len(p) < PIECE][:400], rng, spelled)
        examples = good + extra + plain
        y = np.array([1.0] * (len(good) + len(extra)) + [-1.0] * len(plain))
        most = max(tally.values())
        weight = np.array([1 + 4 * (tally[p] / most) ** 0.5 for p in good] + [0.5] * len(extra) + [1.0] * len(plain))
        weight[y > 0] *= 4
        features = kernel.against(examples, used, tables) @ root
        w = _svm(features, y, weight)
        # kernel values to the landmarks are sums over triples, so the machine is one table of triples
        table = ((root @ w[:-1]) @ tables).astype(np.float32)
        model = Model(kernel, used, table, float(w[-1]), 1.0, 0.0)
        if turn + 1 == rounds:
            break
        flat = sorted({p for b in open_bags for p in b})
        margin = dict(zip(flat, model.margins(flat).tolist(), strict=True))
        best = [max(b, key=margin.__getitem__) for b in open_bags]
        picked = (sure or picked) + [p for p in best if margin[p] > 0 and not clean_count[p]]
        near = model.margins(clean_words)
        hard = [clean_words[i] for i in np.argsort(-near)[:3000].tolist() if near[i] > -0.9]
        plain = list(dict.fromkeys(plain + hard))
    # the curve is drawn through the worst word of each clean text and every sure word of a toxic one, because a text
    # may hold only one of them
    flat = sorted({p for b in clean for p in b} | {p for b in toxic for p in b})
    margin = dict(zip(flat, model.margins(flat).tolist(), strict=True))
    low = [max((margin[p] for p in b), default=model.bias) for b in clean]
    high, share = [], []
    for b in toxic:
        own = [margin[p] for p in b if telling.get(p, 0) >= witnesses] or [m for m in [max(margin[p] for p in b)] if m > 0]
        high += own
        share += [1 / max(1, len(own))] * len(own)
    model.slope, model.shift = _logistic(
        np.array(low + high), np.array([0.0] * len(low) + [1.0] * len(high)), np.array([1.0] * len(low) + share))
    return model


def learn(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          toxic: int = 1500, clean: int = 4000, **options) -> Model | None:
    """Machine from labelled texts: about ``toxic`` and ``clean`` texts of the two labels, chosen by a hash of the key.

    These texts are read whole; one task gets their distinct words and fits the machine, the driver gets
    the machine only. Rows without a label or a text are left out. None if either label is missing.
    """
    known = labels.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{label}`").cast("int").alias("__y")).filter("__k is not null and __y in (0, 1)").distinct()
    sizes = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, toxic / sizes[1]))).otherwise(F.lit(min(1.0, clean / sizes[0])))
    chosen = known.filter(F.pmod(F.xxhash64("__k"), F.lit(1_000_000)) < share * 1_000_000)
    rows = texts.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(chosen), "__k").filter("__text is not null")

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"y": frame["__y"], "words": [" ".join(sorted(set(units(t)))) for t in frame["__text"]]})

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # copies of a text would count as several witnesses
        bags = sorted({(int(y), w) for frame in frames for y, w in zip(frame["y"], frame["words"], strict=True)})
        yield pd.DataFrame({"model": [pickle.dumps(fit(((y, w.split()) for y, w in bags), **options))]})

    found = rows.mapInPandas(words, "y int, words string").coalesce(1).mapInPandas(fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score(df: DataFrame, model: Model | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with score (0 to 1), predicted (1 from ``threshold`` on) and worst_word.

    * Null, empty and wordless texts: the score of a word without any known triple, which is low.
    * Without a model (no toxic or no clean example): score 0, predicted 0.
    * Ties among words: the first in the text. Repeated rows are scored each. Empty table: no rows.
    * Columns named like a result are replaced; the score reads nothing but the text.

    A row at a time, without a shuffle; the model is one table of a fixed size (at most 1 MB).
    """
    own = {"score", "predicted", "worst_word"} - {text.lower()}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])
    if model is None:
        return base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "worst_word": F.lit("")})
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, word string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for batch in batches:
            yield pd.DataFrame(shared.value.score(batch, known), columns=["score", "word"])

    return base.withColumn("__s", of(F.col(f"`{text}`"))).withColumns({
        "score": F.col("__s.score"), "predicted": (F.col("__s.score") >= threshold).cast("int"), "worst_word": F.col("__s.word"),
    }).drop("__s")
