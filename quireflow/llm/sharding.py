"""Sharding by jump consistent hashing: a stable key and the shard count decide, without a ring table.

The hash walks a key-seeded sequence of jumps; the last jump below the shard count is the shard. Appending a shard
moves a key only if one of its jumps lands on the new shard, so about 1/(n + 1) of the rows move, all into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.llm.common import spread, written

LOW = 0xFFFFFFFF
#: Multiplier of the 64-bit linear congruential generator of the published algorithm (fixed value).
MULTIPLIER = 2862933555777941757
#: Cells into which the slots of a shard are counted; shards x CELLS rows are the only thing that is broadcast.
CELLS = 1024


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 in 32-bit halves: no product reaches 2^53, so ANSI arithmetic can't overflow."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & LOW
    bits = lambda x: x.bitwiseAND(F.lit(LOW))
    times = lambda x, m: bits(F.shiftleft((x * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF)), 16) + x * F.lit(m & 0xFFFF))
    high_part = lo * F.lit(ml >> 16)
    low = lo * F.lit(ml & 0xFFFF) + F.lit(1) + F.shiftleft(high_part.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(high_part, 16)
    return bits(carry + times(hi, ml) + times(lo, mh)), bits(low)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a 64-bit key among ``shards``, and among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    last = shards + 1
    start = F.struct(
        F.lit(0).cast("int").alias("shard"), F.lit(0).cast("int").alias("grown"), F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        at = s["next"].cast("int")
        hi, lo = _next(s["hi"], s["lo"])

        def jumped(k: Column) -> Column:
            # the published draw uses the top 31 bits of the 64-bit state
            jump = F.floor((at + 1) * (F.lit(2147483648.0) / (F.shiftright(k["hi"], 1) + 1)))
            return F.struct(F.when(at < shards, at).otherwise(s["shard"]).alias("shard"), at.alias("grown"), jump.alias("next"), k["hi"].alias("hi"), k["lo"].alias("lo"))

        moved = F.transform(F.array(F.struct(hi.alias("hi"), lo.alias("lo"))), jumped)[0]
        return F.when(s["next"] >= last, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(last)), start, step, lambda s: F.struct(s["shard"].alias("shard"), s["grown"].alias("grown")))


def shard_documents(df: DataFrame, id_col: str, text_col: str, shards: int = 16) -> DataFrame:
    """Every row with size, CRC-32, shard, gapless slot in the shard, and the shard if there were one more.

    Only (id, size, crc) rows are shuffled, never texts. A slot is the row's rank in its shard's order (cell, id, crc,
    size), found from the cells' counts and the rank in the cell; a cell holds 1/(shards x CELLS) of the rows. Equal
    rows are counted before the shuffle and dealt consecutive slots after it, so many copies of a row don't meet.

    Null texts have size 1 and CRC 0; null ids are a key of their own; other columns are not read; an empty table gives
    an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = base.withColumn("jump", jump_shards(F.xxhash64("doc_id"), shards)).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(1)), F.lit(CELLS)).cast("int"))
    counted = keyed.groupBy("doc_id", "size", "text_crc32", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown_shard"), "cell").agg(F.count("*").alias("copies"))
    rows = written(counted, "shard-rows")
    by_shard = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("shard", "cell").agg(F.sum("copies").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    in_cell = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(cells), ["shard", "cell"]).withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(in_cell), F.lit(0)))
    dealt = spread(F.col("copies"), "copy", placed, *[F.col(c) for c in ("doc_id", "size", "text_crc32", "shard", "grown_shard", "first")])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")
