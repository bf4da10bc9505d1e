"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of its own size or less; a window found in a document in full
marks the document's words there. Words are ordered by rarity over all documents. A document that
holds a window also holds the window's rarest word, at one known distance from the window's start,
so only that prefix word of each window is joined. The distance gives the start (positional
bound), the start and the document's length must leave room for the window (length bound), and
what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import ascii_lower, stored, tag

#: Windows that may be sent to every task (about 200 bytes each).
BROADCAST_ROWS = 100_000


def _cased_words(text: Column) -> Column:
    """Words as written; a and A are letters of the same words, so the case is dealt with later."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, words) for each run of ``window`` words of an item; one shorter run if it has fewer words, none without words."""
    words = F.transform(_cased_words(F.col(f"`{text}`")), ascii_lower)
    size = F.least(F.lit(window), F.size("__w"))
    return (
        items.select(F.col(f"`{item}`").cast("string").alias("item"), words.alias("__w")).filter(F.size("__w") > 0)
        .withColumn("__at", F.explode(F.sequence(F.lit(1), F.size("__w") - size + 1)))
        .select("item", F.slice("__w", F.col("__at"), size).alias("words")).distinct()
    )


def _small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def prefix_words(docs: DataFrame, text: str, windows: DataFrame) -> DataFrame:
    """``windows`` with the rarest of their words over all documents, and its place in the window.

    Words are joined in full lower case, which equal words share; the exact comparison follows later.
    """
    places = windows.select("item", "words", F.posexplode("words").alias("place", "__word")).withColumn("key", F.lower("__word"))
    wanted = places.select("key").distinct()
    small = _small(wanted, BROADCAST_ROWS)
    seen = docs.select(F.explode(_cased_words(F.col(f"`{text}`"))).alias("__word")).select(F.lower("__word").alias("key"))
    counts = seen.join(F.broadcast(wanted) if small else wanted, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rare = F.struct(F.col("n"), F.col("key"), F.col("place"))
    return (
        places.join(F.broadcast(counts) if small else counts, "key")
        .groupBy("item", "words").agg(F.min(rare).alias("__rare"), F.count(F.lit(1)).alias("__found"))
        .filter(F.col("__found") == F.size("words"))  # a window with a word that no document has occurs nowhere
        .select("item", "words", F.col("__rare.key").alias("key"), F.col("__rare.place").alias("place"))
    )


def occurrences(docs: DataFrame, rows: list[str], text: str, windows: DataFrame) -> DataFrame:
    """(rows..., item, start, size) for every place of a document where a window stands. ``rows`` names a document."""
    prefixes = stored(prefix_words(docs, text, windows).select(
        "item", "key", "place", F.size("words").alias("size"), F.array_join("words", " ").alias("joined")))
    whole = docs.select(*rows, _cased_words(F.col(f"`{text}`")).alias("__w"))
    # Written without lambda functions: the explode, the join and this comparison then run as one generated loop, which
    # never holds a document's words once for each word.
    start = F.col("__pos") - F.col("place")
    room = (start >= 0) & (start + F.col("size") <= F.size("__w"))
    exact = ascii_lower(F.array_join(F.slice("__w", start + 1, F.col("size")), " ")) == F.col("joined")
    if _small(prefixes, BROADCAST_ROWS):
        near = whole.select(*rows, "__w", F.posexplode("__w").alias("__pos", "__word")).withColumn("key", F.lower("__word")).join(
            F.broadcast(prefixes), "key")
        return near.filter(room).filter(exact).select(*rows, "item", start.alias("start"), "size")
    # the words of a document do not travel with each of its words: candidates first, then one join back
    candidates = (
        whole.select(*rows, F.size("__w").alias("__n"), F.posexplode("__w").alias("__pos", "__word")).withColumn("key", F.lower("__word"))
        .join(prefixes, "key").filter((start >= 0) & (start + F.col("size") <= F.col("__n"))).select(*rows, "item", "joined", "size", "place", "__pos"))
    return candidates.join(whole, rows).filter(room).filter(exact).select(*rows, "item", start.alias("start"), "size")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    Words are runs of ASCII letters, digits and anything beyond ASCII, with A-Z in lower case. A
    window is ``window`` consecutive words of an item, or the whole item if it has fewer. n_hit
    counts the words inside occurrences of windows, n_items the items they come from, and
    items_sha256 is the SHA-256 of their ids, sorted as strings and joined by commas.

    * Null or wordless text: no words, no hits. Null or wordless item: no windows. Null item id:
      its windows hit, but it is not counted among the items.
    * Repeated rows each get the same result; one key may have several texts. Empty tables: no
      rows, or no hits. Columns named like a result are replaced; others stay.

    Only joined places move between tasks, keyed by document; the documents' own rows, with the
    columns that are asked for, move once for the final join.
    """
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    taken = set(own) - {key.lower(), text.lower()}
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]).withColumns({
        "__t": tag(F.col(f"`{key}`")), "__h": F.xxhash64(F.col(f"`{text}`")),
        "n_words": F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")})
    found = occurrences(named, ["__t", "__h"], text, item_windows(items, item, item_text, window))
    before = Window.partitionBy("__t", "__h").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = end - F.least(end, F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    hits = found.withColumn("__fresh", fresh).groupBy("__t", "__h").agg(
        F.sum("__fresh").cast("long").alias("n_hit"), F.collect_set("item").alias("__items"))
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    return named.join(hits, ["__t", "__h"], "left").withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
        "n_items": F.size(listed).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.sort_array(listed), ",").cast("binary"), 256),
    }).withColumn("contaminated", F.col("n_hit") > 0).drop("__t", "__h", "__items")
