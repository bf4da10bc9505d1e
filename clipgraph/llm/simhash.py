"""SimHash fingerprints, and near fingerprints by a Gray-order hierarchical index.

Fingerprints that differ in few bits agree on a whole masked pattern: with the 64 bits cut into
``bits + 2`` segments, two fingerprints at distance ``bits`` or less agree on two segments at
least. Each choice of two segments is a mask, and the upper nodes of the index are the masked bit
patterns. Below an upper node, fingerprints are sorted by Gray rank, so that neighbours share long
bit patterns, and runs of them form nodes with the bits they share. Two runs are compared only if
the differences of their shared bits, added to those met before, are still within the limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import Scratch, stored, tag
from clipgraph.llm.components import components

#: Rows of an upper node that one task compares; larger nodes are cut into parts that are paired.
NODE_ROWS = 4096
#: Fingerprints of a lowest node.
LEAF = 16
#: Shingles that are hashed in one go.
CHUNK = 1 << 16
#: Rows from which common shingles are counted, how many of them make one common, and how many common ones are known at most.
SAMPLE, COMMON, KNOWN = 4000, 3, 50_000
#: Share of a set that it shows beyond what is needed to share one shingle.
MORE = 0.1
#: Factor between the words of a shingle in sets.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _votes(text: str, shingle: int, weighting: str) -> tuple[np.ndarray, float]:
    """For each bit, from the highest, the weight of the shingles that set it; and the whole weight."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    votes, total = np.zeros(64), 0.0
    if weighting == "length":
        words = sorted(set(words))
    if not words:
        return votes, total
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    for at in range(0, n, CHUNK):
        spans = list(zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist(), strict=True))
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(spans))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        if weighting == "length":
            weights = np.array([b - a for a, b in spans], float)
            votes += weights @ bits
            total += weights.sum()
        else:
            votes += bits.sum(0)
            total += len(spans)
    return votes, total


def fingerprint(text: str | None, shingle: int = 4, weighting: str = "count") -> int:
    """64-bit SimHash, as a signed number; 0 without words."""
    votes, total = _votes(text or "", shingle, weighting)
    return int(np.packbits(votes * 2 > total).view(">i8")[0])


def fingerprint_column(text: Column, shingle: int = 4, weighting: str = "count") -> Column:
    @F.pandas_udf("long")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, weighting) for t in batch], dtype="int64")

    return of(text)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, weighting: str = "count",
                 name: str = "fp") -> DataFrame:
    """(key, fp) for every row. Null and empty texts have fingerprint 0.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a shingle is
    ``shingle`` words joined by spaces, or the whole text if it has fewer. ``weighting`` is
    ``count`` (each occurrence of a shingle counts once) or ``length`` (each distinct word counts
    by its length, which makes the fingerprint less sensitive to single changed words).
    """
    return df.select(F.col(f"`{key}`"), fingerprint_column(F.col(f"`{text}`"), shingle, weighting).alias(name))


def masks(bits: int) -> list[int]:
    """Masks of two segments out of ``bits + 2``."""
    m = bits + 2
    cut = [round(i * 64 / m) for i in range(m + 1)]
    part = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(m)]
    return [part[a] | part[b] for a, b in combinations(range(m), 2)]


def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in Gray order: each bit is the parity of the bits from the top down to it."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Fingerprints by Gray rank under nodes that hold the bits their fingerprints share."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(_gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        starts = np.arange(0, len(fps), LEAF)
        ones, any_ones = np.bitwise_and.reduceat(self.fps, starts), np.bitwise_or.reduceat(self.fps, starts)
        self.levels = [(ones | ~any_ones, ones)]
        while len(self.levels[-1][0]) > LEAF:
            same, value = self.levels[-1]
            starts = np.arange(0, len(same), LEAF)
            low, high = np.bitwise_and.reduceat(value & same, starts), np.bitwise_or.reduceat(value | ~same, starts)
            self.levels.append((low | ~high, low))

    def near(self, other: GrayIndex, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (here, there) of all fingerprints within ``bits``, level by level from the top."""
        top = max(len(self.levels), len(other.levels)) - 1
        a, b = np.meshgrid(np.arange(len(self._at(top)[0])), np.arange(len(other._at(top)[0])), indexing="ij")
        a, b = a.ravel(), b.ravel()
        for level in range(top, -1, -1):
            (sa, va), (sb, vb) = self._at(level), other._at(level)
            keep = np.bitwise_count((va[a] ^ vb[b]) & sa[a] & sb[b]) <= bits
            a, b = a[keep], b[keep]
            wide_a = level > 0 and level < len(self.levels)
            wide_b = level > 0 and level < len(other.levels)
            size_a = len(self._at(level - 1)[0]) if level else len(self.fps)
            size_b = len(other._at(level - 1)[0]) if level else len(other.fps)
            a, b = _spread(a, b, size_a, wide_a or not level, size_b, wide_b or not level)
        keep = np.bitwise_count(self.fps[a] ^ other.fps[b]) <= bits
        return self.order[a[keep]], other.order[b[keep]]

    def _at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[min(level, len(self.levels) - 1)]


def _spread(a: np.ndarray, b: np.ndarray, size_a: int, wide_a: bool, size_b: int, wide_b: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes to pairs of their children."""
    i = np.arange(LEAF)
    ca = (a[:, None] * LEAF + i) if wide_a else a[:, None]
    cb = (b[:, None] * LEAF + i) if wide_b else b[:, None]
    left = np.repeat(ca, cb.shape[1], axis=1).ravel()
    right = np.tile(cb, (1, ca.shape[1])).ravel()
    ok = (left < size_a) & (right < size_b)
    return left[ok], right[ok]


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join the same rows as all the given ones, at most ``n - 1``."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _node_links(fps: np.ndarray, ids: np.ndarray, side: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links inside one task's part of an upper node: within side 0, or between sides 0 and 1."""
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1)
    out: list[tuple[int, int]] = []
    if len(fps) <= 2 * LEAF and not len(second):
        x, y = np.triu_indices(len(fps), 1)
        keep = np.bitwise_count(fps[x] ^ fps[y]) <= bits
        pairs = _spanning(x[keep], y[keep], len(fps))
    else:
        one = GrayIndex(fps[first])
        a, b = one.near(GrayIndex(fps[second]) if len(second) else one, bits)
        a, b = first[a], (second if len(second) else first)[b]
        keep = a != b
        pairs = _spanning(a[keep], b[keep], len(fps))
    out += [(int(ids[x]), int(ids[y])) for x, y in pairs]
    return out


def near_links(fps: DataFrame, bits: int, fp: str = "fp", rep: str = "rep") -> DataFrame:
    """(src, dst): links between rows of different fingerprints within ``bits``.

    ``fps`` has one row for each fingerprint, with a number that stands for it. Under each upper
    node the links are thinned to those that still join the same rows: a node of n rows gives at
    most n - 1 (each pair of parts of a large node likewise).

    An upper node with more than ``NODE_ROWS`` rows is cut into parts by hash, and every pair of
    parts is its own unit of work, so no task holds a whole node.
    """
    spark = fps.sparkSession
    chosen = masks(bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    routed = fps.select(
        F.col(fp).alias("__fp"), F.col(rep).alias("__id"),
        F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("__mask", "__pat"),
    )
    sizes = routed.groupBy("__mask", "__pat").agg(F.count(F.lit(1)).alias("__n"))
    large = stored(sizes.filter(F.col("__n") > NODE_ROWS).withColumn("__parts", F.ceil(F.col("__n") / NODE_ROWS).cast("int")))
    columns = ["__mask", "__pat", "__one", "__two", "__side", "__fp", "__id"]
    if large.isEmpty():
        work = routed.withColumns({"__one": F.lit(0), "__two": F.lit(0), "__side": F.lit(0)})
    else:
        dealt = routed.join(large.drop("__n"), ["__mask", "__pat"], "left")
        parts = F.coalesce("__parts", F.lit(1))
        mine = F.pmod(F.hash("__id"), parts)
        pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(
            F.least(o, mine).alias("one"), F.greatest(o, mine).alias("two"), (mine > o).cast("int").alias("side")))
        work = dealt.withColumn("__part", mine).withColumn("__p", F.explode(pairs)).select(
            "__mask", "__pat", F.col("__p.one").alias("__one"), F.col("__p.two").alias("__two"),
            F.col("__p.side").alias("__side"), "__fp", "__id")
    keys = ["__mask", "__pat", "__one", "__two"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    work = work.select(*columns).repartition(tasks, *keys).sortWithinPartitions(*keys)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            done, held = _complete(held)
            yield from _emit(done, bits)
        if held is not None:
            yield from _emit(held, bits)

    return work.mapInArrow(links, "src long, dst long")


def _starts(t: pa.Table) -> np.ndarray:
    """First row of each unit of work in rows sorted by it."""
    n = t.num_rows
    change = np.zeros(n, bool)
    if n:
        change[0] = True
    for c in ("__mask", "__pat", "__one", "__two"):
        v = t.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _complete(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows whose unit of work has ended, and the rest."""
    starts = _starts(t)
    cut = int(starts[-1]) if len(starts) else 0
    return t.slice(0, cut), t.slice(cut)


def _emit(t: pa.Table, bits: int) -> Iterator[pa.RecordBatch]:
    starts = _starts(t)
    sizes = np.diff(np.append(starts, t.num_rows))
    fps, ids, side = t.column("__fp").to_numpy().view(np.uint64), t.column("__id").to_numpy(), t.column("__side").to_numpy()
    out: list[tuple[int, int]] = []
    pairs = starts[sizes == 2]
    if len(pairs):
        near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= bits]
        out += zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True)
    for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        out += _node_links(fps[a : a + n], ids[a : a + n], side[a : a + n], bits)
    if out:
        src, dst = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def near_groups(fps: DataFrame, bits: int = 4, key: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(key, fp, component_id) for rows of (key, fp): the smallest key reachable over links of at most ``bits``.

    Other columns are kept. ``fps`` must be a stored table, since it is read twice. Rows with a
    null key get the component of their fingerprint and, if it has no key at all, null.
    """
    distinct = stored(fps.groupBy(fp).agg(F.min(key).alias("__rep")).filter(F.col("__rep").isNotNull()))
    found = components(near_links(distinct, bits, fp, "__rep"))
    named = distinct.join(found, F.col("__rep") == F.col("node"), "left").select(
        F.col(fp).alias("__fp"), F.coalesce("component", "__rep").alias("component_id"))
    return fps.join(named, F.col(fp) == F.col("__fp"), "left").drop("__fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``df``.

    * Null, empty and blank texts: fingerprint 0, linked like any other.
    * Repeated rows and equal texts share fingerprint and component. Empty table: no rows.
    * Other columns are not read, so their names do not matter.

    Equal fingerprints are one row of the index. Only numbers move: 8 bytes of fingerprint and the
    key, once for each mask.
    """
    fps = stored(fingerprints(df, key, text, shingle))
    out = near_groups(fps, bits, key)
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


def shingle_set(text: str, shingle: int, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """Hashes of the distinct shingles of a text in rising order; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    of = np.fromiter(map((_Hashes() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1 if words else 0
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = mixed * FACTOR + of[i : n + i]
    return np.unique(_scattered(mixed).view(np.int64))


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _described(text: Column, shingle: int, similarity: float, common: np.ndarray) -> Column:
    """Word-level fingerprint, checksum of the shingle set, its least shingle in two other orders, and the shingles it must show.

    A set of n shingles shows its first n - ceil(similarity * n) + k in one order for all: that of the
    hashes, ``common`` ones last. Two sets alike show k in common, whatever is taken as common; k is
    1 + floor(MORE * n), and ``__need`` the least k of a set that may be alike.
    """

    @F.pandas_udf("fp long, __same string, __least1 long, __least2 long, __need long, __shown array<long>")
    def of(batch: pd.Series) -> pd.DataFrame:
        hashes, rows = _Hashes(), []
        for t in batch:
            found = shingle_set(t, shingle, hashes)
            least = [_scattered(found.view(np.uint64) + np.uint64(salt)).min().view(np.int64) for salt in (1, 2)]
            last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(len(found), bool)
            shown = np.concatenate((found[~last], found[last]))[: len(found) - int(np.ceil(len(found) * similarity - 1e-9)) + int(MORE * len(found)) + 1]
            need = int(MORE * similarity * len(found) * (1 - 1e-9)) + 1
            rows.append((fingerprint(t, 1, "length"), hashlib.md5(found.tobytes()).hexdigest(), *least, need, shown))
        return pd.DataFrame(rows, columns=["fp", "__same", "__least1", "__least2", "__need", "__shown"])

    return of(text)


def _set_of(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(batch: pd.Series) -> pd.Series:
        hashes = _Hashes()
        return pd.Series([shingle_set(t, shingle, hashes) for t in batch], dtype=object)

    return of(text)


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8,
                     bits: int = 4) -> DataFrame:
    """``df`` less the rows that repeat another row's text or nearly so.

    Texts are held against each other by the Jaccard similarity of their shingle sets: first those
    whose word-level fingerprints are linked at ``bits`` or fewer, then all that share one of the
    shingles that similar sets must share. No pair at ``similarity`` or more is missed, unless 64-bit
    hashes collide. A row goes if it is linked, over rows that alike, to one with a smaller key. The
    smallest key of each such group stays.

    * Null texts and texts without words are never copies and all stay.
    * Repeated rows and rows of equal text: the one with the smallest key stays; if rows share
      even the key, one of them stays. Texts that have only null keys: one row of each stays.
    * Empty table: no rows. All columns are kept as they are.

    Intermediate tables are written to the shared folder and deleted as soon as nothing needs them.
    """
    body = F.col(f"`{text}`")
    plain = df.select(
        F.col(f"`{key}`").alias("__k"), F.md5(body).alias("__md5"), body.alias("__text"),
        F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("__words"))
    plain = plain.filter("__words").drop("__words")
    scratch = Scratch(df.sparkSession, "near-copies")
    common = _common(plain, shingle)
    rows = scratch.keep("rows", plain.select("__md5", "__k", _described(F.col("__text"), shingle, similarity, common).alias("__d"))
                        .select("__md5", "__k", "__d.*").withColumn("__id", F.xxhash64("__same")).drop("__same"))
    texts = scratch.keep("texts", rows.groupBy("__md5", "__id").agg(F.min("__k").alias("__k")))
    # texts of equal sets are one node, however many copies there are
    least = [F.min(c).alias(c) for c in ("fp", "__least1", "__least2", "__need")]
    nodes = scratch.keep("nodes", rows.filter("__k is not null").groupBy("__id").agg(
        F.min(F.struct("__k", "__md5")).alias("__one"), F.first("__shown").alias("__shown"), *least).select("__id", "__one.*", "__shown", "fp", "__least1", "__least2", "__need"))
    scratch.drop("rows")
    gone = _copies(scratch, texts.filter("__k is not null"), nodes, plain, shingle, similarity, bits)
    stay = scratch.keep("stay", texts.select("__md5", "__k").join(gone, "__md5", "left_anti").select("__md5", tag(F.col("__k")).alias("__t")))
    scratch.drop("texts", "nodes", "met", "sets", "links", "labels", "rest")
    named = df.withColumns({
        "__md5": F.when(F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.md5(body)),
        "__t": tag(F.col(f"`{key}`"))})
    once = Window.partitionBy("__md5", "__t").orderBy(F.xxhash64(*_all(df)))  # rows alike in key and text differ in other columns at most
    first = (
        named.filter("__md5 is not null").join(stay, ["__md5", "__t"], "left_semi")
        .withColumn("__first", F.row_number().over(once)).filter("__first = 1"))
    return first.select(*_all(df)).unionByName(named.filter("__md5 is null").select(*_all(df)))


def _all(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _copies(scratch: Scratch, texts: DataFrame, nodes: DataFrame, plain: DataFrame, shingle: int, similarity: float, bits: int) -> DataFrame:
    """MD5 of the texts that are linked to one with a smaller key.

    Nodes that share no shown shingle with another have no near copy. Links are only added, no node
    leaves before all its links are made: first, nodes are held against the first one of their
    buckets (fingerprint group, least shingle in two orders), which joins most of a large group with
    few comparisons; what these links have not joined yet is compared pair by pair.
    """
    shared = scratch.keep("shared", _met(nodes))
    enough = shared.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).join(nodes.select("__id", "__need"), "__id").filter("__n >= __need")
    met = scratch.keep("met", shared.join(enough.select("__id"), "__id", "left_semi"))
    scratch.drop("shared")
    ones = nodes.select("__id", "__k", "__md5").join(met.select("__id").distinct(), "__id", "left_semi")
    sets = scratch.keep("sets", plain.join(ones, ["__md5", "__k"]).dropDuplicates(["__id"]).select("__id", _set_of(F.col("__text"), shingle).alias("__set")))
    grouped = near_groups(nodes.select("__id", "__k", "fp", "__least1", "__least2"), bits, "__id")
    buckets = grouped.join(met.select("__id").distinct(), "__id", "left_semi").select("__id", "__k", F.explode(F.array(
        F.xxhash64(F.lit(0), "component_id"), F.xxhash64(F.lit(1), "__least1"), F.xxhash64(F.lit(2), "__least2"))).alias("__b"))
    heads = buckets.groupBy("__b").agg(F.min(F.struct("__k", "__id")).alias("__h")).select("__b", F.col("__h.__id").alias("__head"))
    stars = buckets.join(heads, "__b").filter("__id <> __head").select(
        F.least("__id", "__head").alias("__one"), F.greatest("__id", "__head").alias("__two")).distinct()
    links = scratch.keep("links", _linked(stars, sets, similarity))
    labels = scratch.keep("labels", _labels(sets, links))
    between = met.join(labels, "__id")
    mixed = between.groupBy("__shingle").agg(F.min("__label").alias("__l1"), F.max("__label").alias("__l2")).filter("__l1 <> __l2")
    apart = labels.join(between.join(mixed, "__shingle", "left_semi").select("__id").distinct(), "__id", "left_semi")
    rest = scratch.keep("rest", _linked(_pairs_left(sets.join(apart, "__id"), similarity), sets, similarity))
    joined = texts.join(_labels(nodes, links.union(rest)), "__id")
    stay = joined.groupBy("__label").agg(F.min(F.struct("__k", "__md5")).alias("__first")).select(F.col("__first.__md5").alias("__md5"))
    return joined.select("__md5").join(stay, "__md5", "left_anti")


def _common(plain: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that several texts of a hash sample hold; they only order the search and leave nothing out."""
    every = max(1, plain.count() // SAMPLE)
    some = plain.filter(F.pmod(F.xxhash64("__md5", F.lit(7)), F.lit(every)) == 0).dropDuplicates(["__md5"])
    found = some.select(F.explode(_set_of(F.col("__text"), shingle)).alias("__shingle")).groupBy("__shingle").agg(F.count(F.lit(1)).alias("__n"))
    most = found.filter(F.col("__n") >= COMMON).orderBy(F.desc("__n"), "__shingle").limit(KNOWN).collect()
    return np.sort(np.array([r["__shingle"] for r in most], np.int64))


def _met(rows: DataFrame) -> DataFrame:
    """(__shingle, __id): shingles that several nodes show."""
    of = Window.partitionBy("__shingle")
    return rows.select("__id", F.explode("__shown").alias("__shingle")).withColumns(
        {"__first": F.min("__id").over(of), "__last": F.max("__id").over(of)}).filter("__first <> __last").select("__shingle", "__id")


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(__id, __label): the smallest node that each one reaches."""
    return nodes.select("__id").join(components(links), F.col("__id") == F.col("node"), "left").select(
        "__id", F.coalesce("component", "__id").alias("__label"))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): the pairs whose sets are alike."""
    both = F.size(F.array_intersect("__s1", "__s2"))
    return (
        pairs.join(sets.withColumnsRenamed({"__id": "__one", "__set": "__s1"}), "__one")
        .join(sets.withColumnsRenamed({"__id": "__two", "__set": "__s2"}), "__two")
        .filter(both / (F.size("__s1") + F.size("__s2") - both) >= similarity).select(F.col("__one").alias("src"), F.col("__two").alias("dst")))


def _pairs_left(rows: DataFrame, similarity: float) -> DataFrame:
    """(__one, __two) of different labels that may be alike: similar sets share one of the rarest shingles of both.

    Shingles are ordered by their number of texts. A set of n shingles shows its first
    n - ceil(similarity * n) + 1; those that no other text has come first and need not be joined, so
    texts that have only a common passage in common do not meet. From a shared shingle on, the sets
    must have enough shingles left.
    """
    each = rows.select("__id", "__label", F.size("__set").alias("__n"), F.explode("__set").alias("__shingle"))
    shared = each.groupBy("__shingle").agg(
        F.count(F.lit(1)).alias("__df"), F.min("__label").alias("__l1"), F.max("__label").alias("__l2")).filter("__df > 1")
    rank = F.row_number().over(Window.partitionBy("__id").orderBy("__df", "__shingle"))
    alone = F.col("__n") - F.count(F.lit(1)).over(Window.partitionBy("__id"))
    shown = stored(
        each.join(shared, "__shingle").withColumn("__at", alone + rank)
        .filter(F.col("__at") <= F.col("__n") - F.ceil(F.col("__n") * similarity - 1e-9) + 1)
        .filter("__l1 <> __l2").select("__shingle", "__id", "__label", "__n", "__at"))
    a, b = shown.alias("a"), shown.alias("b")
    # for the first shared shingle of a pair, which both show, nothing before its places is shared
    most = 1 + F.least(F.col("a.__n") - F.col("a.__at"), F.col("b.__n") - F.col("b.__at"))
    return a.join(b, (F.col("a.__shingle") == F.col("b.__shingle")) & (F.col("a.__id") < F.col("b.__id"))
                  & (F.col("a.__label") != F.col("b.__label"))
                  & (most * (1 + similarity) + 1e-6 >= (F.col("a.__n") + F.col("b.__n")) * similarity)).select(
        F.col("a.__id").alias("__one"), F.col("b.__id").alias("__two")).distinct()
