"""Encoding texts into the pieces of a merge-type vocabulary, and decoding them again.

A text starts as its characters. An agenda holds every two neighbours whose union is a piece, the
best score first and the leftmost among equals; taking one off merges it and puts its new
neighbours on. What is left at the end are the pieces. Two neighbouring characters that stand side by
side in no piece can never be merged, so long parts are cut there first, and equal parts are merged
only once.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import without

#: The character that stands for a space inside pieces. Fixed value of the vocabulary format.
SPACE = "▁"
#: Parts whose pieces a task remembers before it starts anew, and characters of the longest one that it remembers.
REMEMBERED, LONGEST = 200_000, 48
#: Characters of texts that are split and merged side by side.
TOGETHER = 1 << 20

codecs.register_error("one_by_one", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        head = number()
        kind = head & 7
        if kind == 0:
            yield head >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield head >> 3, raw[at:at + size]
        at += size


class Vocabulary:
    """Pieces, scores and settings of a model file.

    Only merge-type models with byte pieces, no normalisation table, no user-defined and no unused
    pieces are taken; others raise ValueError.
    """

    # fixed values of the file format: field numbers, kinds of pieces and of models
    PIECES, TRAINER, NORMALIZER = 1, 2, 3
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    MERGES = 2

    def __init__(self, raw: bytes):
        top = list(_fields(raw))
        train = {k: v for n, part in top if n == self.TRAINER for k, v in _fields(part)}
        norm = {k: v for n, part in top if n == self.NORMALIZER for k, v in _fields(part)}
        if train.get(3) != self.MERGES or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or train.get(24, 0):
            raise ValueError("not a merge-type model with plain text settings")
        self.prefix = SPACE if norm.get(3, 1) else ""
        self.unknown_text = train.get(44, " ⁇ ".encode())
        self.begin, self.end = train.get(41, 1), train.get(42, 2)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        for n, part in top:
            if n != self.PIECES:
                continue
            at = dict(_fields(part))
            piece, kind = at[1].decode(), at.get(3, self.NORMAL)
            number = len(self.surface)
            if kind in (self.USER, self.UNUSED):
                raise ValueError(f"piece {number} is of a kind that is not taken")
            if kind == self.NORMAL:
                self.ids[piece] = number
                self.scores[piece] = float(np.frombuffer(at.get(2, bytes(4)), "<f4")[0])
                self.surface.append(piece.replace(SPACE, " ").encode())
            elif kind == self.BYTE:
                self.bytes[int(piece[3:-1], 16)] = number
                self.surface.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.surface.append(self.unknown_text if kind == self.UNKNOWN else b"")
        if len(self.bytes) < 256:
            raise ValueError("the model lacks byte pieces")
        self.pairs = {piece[i:i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        apart = not any(p[0] != SPACE and p[1] == SPACE for p in self.pairs)
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s).+")
        # the same in arrays: pieces by score, equal scores of equal rank, and the piece that two neighbours make
        by_score = sorted(self.ids, key=lambda piece: (self.scores[piece], piece))
        at = {piece: k for k, piece in enumerate(by_score)}
        made = sorted(
            (at[p[:i]] << 32 | at[p[i:]], k) for p, k in at.items() for i in range(1, len(p)) if p[:i] in at and p[i:] in at)
        self.pair_keys, self.pair_goal = (np.array([x[k] for x in made], np.int64) for k in (0, 1))
        self.rank = np.append(np.unique([self.scores[p] for p in by_score], return_inverse=True)[1], -1)  # -1: nothing to merge
        self.number = np.array([self.ids[p] for p in by_score], "<u4")
        self.letter = np.full(0x110000, -1, np.int32)
        for piece, k in at.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = k
        self.opens = {number for piece, number in self.ids.items() if piece.startswith(SPACE)}
        self.silent = {number for number, s in enumerate(self.surface) if not s}
        self.first, self.last = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()

    def merge(self, text: str) -> list[int]:
        """Piece numbers of one part, by the agenda; characters without a piece become their bytes."""
        score = self.scores
        symbols = list(text)
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda = [(-score[p], i, 2) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in score]
        heapq.heapify(agenda)
        while agenda:
            _, left, length = heapq.heappop(agenda)
            right = after[left]
            if right >= size or not symbols[left] or len(symbols[left]) + len(symbols[right]) != length:
                continue  # one of the two is merged already
            whole = symbols[left] = symbols[left] + symbols[right]
            symbols[right] = ""
            nxt = after[left] = after[right]
            if nxt < size:
                before[nxt] = left
                joint = whole + symbols[nxt]
                if joint in score:
                    heapq.heappush(agenda, (-score[joint], left, len(joint)))
            prev = before[left]
            if prev >= 0:
                joint = symbols[prev] + whole
                if joint in score:
                    heapq.heappush(agenda, (-score[joint], prev, len(joint)))
        out: list[int] = []
        for symbol in filter(None, symbols):
            number = self.ids.get(symbol)
            out += [number] if number is not None else [self.bytes[b] for b in symbol.encode()]
        return out

    def _goals(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two neighbours make, -1 for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0), self.pair_goal[at], -1)

    def merge_rows(self, parts: list[str]) -> list[bytes]:
        """Packed numbers of many short parts, merged side by side: the agenda of a part is one row of an array.

        In a round every part of one length takes the best pair off its row, the leftmost of equal ones.
        """
        out: list[bytes] = [b""] * len(parts)
        by_size: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            by_size.setdefault(len(part), []).append(k)
        for size, members in by_size.items():
            text = "".join([parts[k] for k in members]).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(text, "<u4").reshape(-1, size).astype(np.int64)
            known = self.letter[codes].astype(np.int64)
            symbols = np.where(known >= 0, known, -1 - codes)  # characters without a piece are below zero
            goals = self._goals(symbols[:, :-1], symbols[:, 1:])
            live = np.array(members)
            while True:
                score = self.rank[goals]
                first = score.argmax(1) if goals.shape[1] else np.zeros(len(live), np.int64)
                rows = np.arange(len(live))
                more = score[rows, first] >= 0 if goals.shape[1] else np.zeros(len(live), bool)
                self._pack(symbols[~more], live[~more].tolist(), out)
                if not more.any():
                    break
                symbols, goals, live, first = symbols[more], goals[more], live[more], first[more]
                rows = np.arange(len(live))
                symbols[rows, first] = goals[rows, first]
                take = np.arange(symbols.shape[1] - 1)
                symbols = np.take_along_axis(symbols, take + (take > first[:, None]), 1)  # less the right neighbour
                take = take[:-1]
                goals = np.take_along_axis(goals, take + (take >= first[:, None]), 1)
                if goals.shape[1]:
                    to = first < goals.shape[1]
                    goals[rows[to], first[to]] = self._goals(symbols[rows[to], first[to]], symbols[rows[to], first[to] + 1])
                    to = first > 0
                    goals[rows[to], first[to] - 1] = self._goals(symbols[rows[to], first[to] - 1], symbols[rows[to], first[to]])
        return out

    def _pack(self, symbols: np.ndarray, places: list[int], out: list[bytes]) -> None:
        plain = (symbols >= 0).all(1)
        raw, step = self.number[np.where(symbols >= 0, symbols, 0)].tobytes(), 4 * symbols.shape[1]
        for k, (place, whole) in enumerate(zip(places, plain.tolist(), strict=True)):
            if whole:
                out[place] = raw[k * step : (k + 1) * step]
                continue
            numbers: list[int] = []
            for symbol in symbols[k].tolist():
                numbers += [int(self.number[symbol])] if symbol >= 0 else [self.bytes[b] for b in chr(-1 - symbol).encode()]
            out[place] = array("I", numbers).tobytes()

    def cut(self, part: str) -> Iterator[str]:
        """``part`` cut between characters that no piece holds side by side."""
        start = 0
        for i in range(1, len(part)):
            if part[i - 1:i + 1] not in self.pairs:
                yield part[start:i]
                start = i
        yield part[start:]

    def split(self, text: str) -> list[str]:
        """The parts of a text, with the space in front."""
        return self.parts.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str], known: dict[str, bytes] | None = None) -> list[bytes]:
        """Packed piece numbers of whole texts between the begin and the end piece; ``known`` holds parts met before."""
        known = {} if known is None else known
        split = [self.split(t) for t in texts]
        fresh = list({p for parts in split for p in parts if p not in known})
        short = [p for p in fresh if len(p) <= LONGEST]
        long = {p: array("I", [n for piece in self.cut(p) for n in self.merge(piece)]).tobytes() for p in fresh if len(p) > LONGEST}
        known.update(zip(short, self.merge_rows(short), strict=True))
        return [b"".join([self.first, *[known[p] if len(p) <= LONGEST else long[p] for p in parts], self.last]) for parts in split]

    def decode(self, packed: bytes) -> str:
        """The text of packed piece numbers: control pieces are silent, the space that encoding put in front goes,
        bytes that are no UTF-8 become U+FFFD one by one. Numbers outside of the vocabulary raise IndexError."""
        numbers = array("I", packed).tolist()
        spans = [[]]  # control pieces part the bytes before them from those after them
        for silent, span in itertools.groupby(numbers, self.silent.__contains__):
            spans += [] if silent else [list(span)]
        texts = [b"".join(map(self.surface.__getitem__, span)).decode("utf-8", "one_by_one") for span in spans]
        opened = self.prefix and len(spans) > 1 and spans[1][0] in self.opens
        return "".join(texts)[1 if opened else 0:]


def read_model(path: str) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary(file.read())


def _groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts, about ``TOGETHER`` characters at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_all(texts: Iterable[str | None], vocabulary: Vocabulary) -> Iterator[list[bytes]]:
    """Packed numbers of texts, one list for each group of them; parts met before are remembered up to a limit."""
    known: dict[str, bytes] = {}
    for group in _groups(texts):
        yield vocabulary.encode(group, known)
        if len(known) > REMEMBERED:
            known.clear()


def encode(df: DataFrame, model: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``df`` with ids (piece numbers as little-endian unsigned 32-bit integers, begin and end included) and n_tokens.

    With ``decoded`` a column of that name holds the text that the numbers decode to, made in the same pass. The model file
    is read where the query is built; its vocabulary, of fixed size, goes to the tasks.

    * Null and empty texts: the begin and the end piece only. Repeated rows are encoded each; empty table: no rows.
    * White space, order and length are kept: a text is read whole. A part of the text that
      nothing cuts is merged at once, in time n log n.
    * Columns named like a result are replaced, all others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))

    @F.pandas_udf("ids binary, decoded string")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value
        for ids in encode_all((t for batch in batches for t in batch), vocabulary):
            yield pd.DataFrame({"ids": ids, "decoded": [vocabulary.decode(i) for i in ids] if decoded else None}, dtype=object)

    out = without(df, ["ids", "n_tokens", *([decoded] if decoded else [])]).withColumn("__p", packed(F.col(f"`{text}`")))
    named = {"ids": F.col("__p.ids"), "n_tokens": F.floor(F.octet_length("__p.ids") / 4)} | ({decoded: F.col("__p.decoded")} if decoded else {})
    return out.withColumns(named).drop("__p")


def decode(df: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed piece numbers as column ``name``; null numbers give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = shared.value
        for batch in batches:
            yield pd.Series([vocabulary.decode(raw or b"") for raw in batch], dtype=object)

    return without(df, [name]).withColumn(name, text(F.col(f"`{ids}`")))


def disagreements(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Rows of ``df`` whose numbers or decoded text differ from what the sentencepiece library gives for them.

    The library reads the texts batch by batch beside the encoder, from the same model file.
    """
    with open(model, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("boolean")
    def differs(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for texts, ids, decoded in batches:
            want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
            yield pd.Series([np.array(w, "<u4").tobytes() != i or library.decode(w) != d for w, i, d in zip(want, ids, decoded, strict=True)])

    both = encode(df, model, text, decoded="decoded")
    return both.filter(differs(F.col(f"`{text}`"), F.col("ids"), F.col("decoded")))
