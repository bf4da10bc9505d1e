"""Sharding by jump consistent hashing, in DataFrame functions only.

A key starts a chain of jumps to ever larger shard numbers; its shard is the last one below the
shard count. The chain does not depend on the count, so appending shards moves a key only if
its chain hits one of the new ones, and no ring table exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import MASK32, without

# fixed value: multiplier of the generator that jump hashing steps through
MULTIPLIER = 2862933555777941757
#: Order ranges of a shard; each is numbered on its own.
RANGES = 4096


def key_bits(df: DataFrame, key: str) -> Column:
    """64 bits of a key: whole numbers as they are, other types hashed, null as 0."""
    col = F.col(f"`{key}`")
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(col.cast("long") if whole else F.xxhash64(col), F.lit(0).cast("long"))


def jump_shards(bits: Column, counts: list[int]) -> Column:
    """Struct with one shard number for each shard count.

    One walk along the chain serves all counts. The state is kept as two 32-bit halves in longs,
    because a 64-bit product overflows.
    """
    top = max(counts)
    c_high, c1, c0 = MULTIPLIER >> 32, (MULTIPLIER & MASK32) >> 16, MULTIPLIER & 0xFFFF
    long = lambda v: F.lit(v).cast("long")

    def step(state: Column, _: Column) -> Column:
        hi, lo, jump = state["hi"], state["lo"], state["jump"]
        middle = lo * long(c1)
        low = F.shiftleft(middle.bitwiseAND(0xFFFF), 16) + lo * long(c0) + long(1)
        high = (
            F.shiftright(middle, 16) + F.shiftright(low, 32) + hi * long(c0)
            + F.shiftleft((hi * long(c1)).bitwiseAND(0xFFFF), 16) + (lo * long(c_high)).bitwiseAND(long(MASK32))
        ).bitwiseAND(long(MASK32))
        after = F.floor((jump + 1) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1))).cast("long")
        moved = F.struct(
            high.alias("hi"), low.bitwiseAND(long(MASK32)).alias("lo"), after.alias("jump"),
            *[F.when(jump < n, jump).otherwise(state[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)],
        )
        return F.when(jump < top, moved).otherwise(state)

    start = F.struct(
        F.shiftrightunsigned(bits, 32).alias("hi"), bits.bitwiseAND(long(MASK32)).alias("lo"), long(0).alias("jump"),
        *[long(0).alias(f"s{i}") for i in range(len(counts))],
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(top)), start, step,
        lambda state: F.struct(*[state[f"s{i}"].cast("int").alias(f"s{i}") for i in range(len(counts))]),
    )


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """``df`` with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: shard and grown_shard (with one shard more) follow from the key and the
    shard count. Rows are numbered from 0 without gaps inside a shard, in the order of the key's
    MD5, the key, the checksum and the size.

    * Null key: key bits 0, ordered as the text "null". Null text: size 8, checksum 0.
    * Rows with one key share a shard, and repeated rows get slots of their own.
    * Empty table: no rows. Columns named like a result are replaced.

    A shard is numbered in up to 4,096 ranges of the MD5, each shifted by the rows before it, so
    no task holds a whole shard; rows of one key are told apart by their text's checksum. The
    table of shifts has at most ``shards`` x 4,096 x 16 rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    placed = without(df, [c for c in own if c not in (key, text)])
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    crc = F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(0).cast("long"))
    placed = placed.withColumn("__j", jump_shards(key_bits(df, key), [shards, shards + 1])).withColumns({
        "size": (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 8).cast("long"),
        "text_crc32": crc,
        "law": F.lit("key"),
        "shard": F.col("__j.s0"),
        "grown_shard": F.col("__j.s1"),
        "__m": digest,
    }).withColumns({
        "__r": F.conv(F.substring("__m", 1, 3), 16, 10).cast("int"),
    }).drop("__j")
    return number_rows(placed, "shard", "__r", ["__m", f"`{key}`", "text_crc32", "size"], "slot").drop("__m", "__r")


def number_rows(df: DataFrame, group: str, span: str, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 inside ``group``, by ``span`` and then ``order``, without a task for a whole group."""
    counts = df.groupBy(group, span).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(group, span, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy(group, span).orderBy(*order)) - 1
    return (
        df.withColumn("__in", inside).join(shifts, [group, span])
        .withColumn(name, (F.col("__in") + F.col("__shift")).cast("long")).drop("__in", "__shift")
    )
