"""Sharding by jump consistent hashing, in DataFrame functions only.

The published algorithm: a 64-bit linear congruential generator, seeded by the
key's hash, draws the next shard count at which the key would move; the last
draw below the number of shards is the key's shard.  There is no ring table, and
a new shard takes 1/(n+1) of the keys and moves no others.

Spark's integers refuse to overflow, so the generator's state is held as two
32-bit halves and multiplied in 16-bit parts.  The expected number of draws is
about ln n; rows that need more than ``_draws(n)`` continue in an exact loop of n.

Slots number the rows of a shard from 0 in the order of a hash of (key, size,
checksum).  The hash's leading digits cut each shard into buckets; counts per bucket
give every bucket's offset, so no task ever sorts a whole shard.

Defined cases: a null text has no bytes and checksum 0; a null key hashes as
the empty string; rows equal in key, size and checksum are interchangeable and get
different slots.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import repeated, saved

# The generator's multiplier as published, in halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF

ROWS_PER_BUCKET = 20_000
LEAST_BUCKETS = 256


def _draws(shards: int) -> int:
    return min(shards, 4 * math.ceil(math.log(shards + 1)) + 4)


def _times_low(x: Column, factor: int) -> tuple[Column, Column]:
    """(high, low) halves of x * factor, both below 2^32."""
    upper = F.shiftright(x, 16) * F.lit(factor)
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftright(upper, 16) + F.shiftright(low, 32), low.bitwiseAND(F.lit(MASK))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state: state * MULTIPLIER + 1 modulo 2^64."""
    carry, low = _times_low(lo, LOW)
    up = low + F.lit(1)
    _, cross1 = _times_low(lo, HIGH)
    _, cross2 = _times_low(hi, LOW)
    high = carry + F.shiftright(up, 32) + cross1 + cross2
    return high.bitwiseAND(F.lit(MASK)), up.bitwiseAND(F.lit(MASK))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of ``key`` (any type) among ``shards``: 0 to shards - 1."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    start = F.struct(half(1).alias("hi"), half(9).alias("lo"), F.lit(-1).cast("long").alias("b"),
                     F.lit(0).cast("long").alias("j"))

    def draw(state: Column, _: Column) -> Column:
        hi, lo = _next(state["hi"], state["lo"])
        jump = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        moved = F.floor((state["j"] + F.lit(1)).cast("double") * jump).cast("long")
        fields = F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), moved.alias("j"))
        return F.when(state["j"] < F.lit(shards), fields).otherwise(state)

    loop = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, draw)
    done = loop(start, _draws(shards))
    if _draws(shards) < shards:
        done = F.transform(F.array(done), lambda s: F.when(s["j"] >= F.lit(shards), s).otherwise(loop(s, shards)))[0]
    return done["b"].cast("int")


def assign_shards(docs: DataFrame, key: str, text: str, shards: int, grow_to: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id`` (the key), ``size``, ``text_crc32``,
    ``shard``, ``slot`` and ``grown_shard`` (the shard among ``grow_to``)."""
    grow_to = grow_to or shards + 1
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(whole).cast("long") + 1).alias("size"),
                       F.crc32(whole.cast("binary")).alias("text_crc32"))
    rows = saved(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows")), "shard-rows")
    total = rows.agg(F.sum("rows")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1, total / shards / ROWS_PER_BUCKET))))
    order = F.md5(F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32").cast("binary"))
    rows = saved(rows.select("*", jump_shard(F.col("doc_id"), shards).alias("shard"),
                             jump_shard(F.col("doc_id"), grow_to).alias("grown_shard"), order.alias("at"))
                 .withColumn("bucket", F.expr(f"cast(conv(substring(at, 1, 8), 16, 10) as bigint) div {(1 << 32) // buckets}")),
                 "shard-keys")
    counts = rows.groupBy("shard", "bucket").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("local", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
    return repeated(placed, "rows", "copy").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("local") + F.col("copy")).alias("slot"), "grown_shard")
