"""Counting greedy word pieces with a linear longest-match automaton.

The vocabulary is a trie over bytes. Where no edge fits, the automaton pops the longest pieces of
what it has read and follows the failure link to the state for the rest; both are computed once
from the vocabulary. Counting needs only how many pieces a link pops, so no piece is built and
every byte is read once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose counts a task remembers before it starts anew.
REMEMBERED = 1 << 19
#: Bytes of the longest word that is read side by side with others, a byte of each in a step; and of the longest one that is remembered.
SIDE_BY_SIDE = 1024


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a vocabulary file with one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie of the pieces with failure links and the number of pieces each link pops."""

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(False)
                at = children[at][b]
            if piece:
                ends[at] = True
        missing = [b for b in range(256) if b not in children[0] or not ends[children[0][b]]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        link, pops = [0] * len(children), [0] * len(children)
        row = [0]
        while row:
            below = []
            for at in row:
                for b, child in children[at].items():
                    if ends[child]:  # the whole path is one piece
                        link[child], pops[child] = 0, 1
                    else:  # as after the parent's pops, then on along b
                        state, popped = link[at], pops[at]
                        while b not in children[state]:
                            popped += pops[state]
                            state = link[state]
                        link[child], pops[child] = children[state][b], popped
                    below.append(child)
            row = below
        keys = np.array([s << 8 | b for s, edges in enumerate(children) for b in edges], np.int64)
        goal = np.array([c for edges in children for c in edges.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.goal = keys[order], goal[order]
        self.link, self.pops = np.array(link, np.int32), np.array(pops, np.int32)
        # every state pops down to the root in the end; what is left of a word then is counted here
        rest = np.zeros(len(children), np.int32)
        row = [0]
        for at in row:
            for child in children[at].values():
                row.append(child)
        for at in row[1:]:
            rest[at] = pops[at] + rest[link[at]]
        self.rest = rest
        self.edges: dict[int, int] | None = None  # made in the task that meets a long word

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, all words read side by side."""
        out = np.zeros(len(words), np.int64)
        long = [i for i, w in enumerate(words) if len(w) > SIDE_BY_SIDE]
        if long:
            short = [i for i, w in enumerate(words) if len(w) <= SIDE_BY_SIDE]
            out[long] = [self._walk(words[i]) for i in long]
            out[short] = self.count([words[i] for i in short])
            return out
        if not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = len(words)
        for i in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes[:live], -i, side="left"))  # words longer than i come first
            byte = text[start[:live] + i].astype(np.int64)
            open_ = np.arange(live)
            while len(open_):
                key = state[open_] << 8 | byte[open_]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                fits = self.keys[at] == key
                state[open_[fits]] = self.goal[at[fits]]
                open_ = open_[~fits]
                count[open_] += self.pops[state[open_]]
                state[open_] = self.link[state[open_]]
        out[order] = count + self.rest[state]
        return out


    def _walk(self, word: bytes) -> int:
        """Pieces of one long word, read alone; every byte is read once."""
        if self.edges is None:
            self.edges = dict(zip(self.keys.tolist(), self.goal.tolist(), strict=True))
        edges, link, pops = self.edges, self.link, self.pops
        state = count = 0
        for byte in word:
            while (after := edges.get(state << 8 | byte)) is None:
                count += int(pops[state])
                state = int(link[state])
            state = after
        return count + int(self.rest[state])


def count_tokens(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, longest) for every row: words, their greedy pieces, and the most pieces of a word.

    Words are runs of anything but ASCII white space. A word is read with one space before it and
    cut into the longest piece of the vocabulary, then the longest of the rest, and so on. The
    vocabulary file is read where the query is built and has a fixed size; every single byte must
    be in it.

    * Null, empty and blank texts: 0, 0, 0. Repeated rows are counted each. Empty table: no rows.
    * Other columns are not read, so their names do not matter.

    A task remembers the counts of at most ``REMEMBERED`` words.
    """
    shared = df.sparkSession.sparkContext.broadcast(Automaton(read_ranks(vocabulary)))
    columns = counts_column(F.col(f"`{text}`"), shared)
    return df.select(F.col(f"`{key}`"), columns.alias("__c")).select(key, "__c.n_words", "__c.n_tokens", "__c.longest")


def counts_column(text: Column, shared) -> Column:
    @F.pandas_udf("n_words long, n_tokens long, longest long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine, known = shared.value, {}
        for batch in batches:
            yield count_batch(batch, machine, known)

    return of(text)


def count_batch(texts: Iterable[str | None], machine: Automaton, known: dict[bytes, int]) -> pd.DataFrame:
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    fresh = list({w for words in split for w in words if w not in known})
    known.update(zip(fresh, machine.count([b" " + w for w in fresh]).tolist(), strict=True))
    rows = []
    for words in split:
        counts = [known[w] for w in words]
        rows.append((len(words), sum(counts), max(counts, default=0)))
    for w in fresh:  # the memory is bounded in bytes, too
        if len(w) > SIDE_BY_SIDE:
            del known[w]
    return pd.DataFrame(rows, columns=["n_words", "n_tokens", "longest"])
