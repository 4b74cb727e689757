"""Jump consistent hashing: a stable key to a shard, without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.operators.common import numbered, settle

# The multiplier of the published jump hash, and its 31-bit range.
MULTIPLIER = 2862933555777941757
RANGE = 1 << 31

_M32, _M16 = (1 << 32) - 1, (1 << 16) - 1


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) halves of key * MULTIPLIER + 1 mod 2**64, in 16-bit partial products:
    no intermediate passes 2**63, so it also runs under ANSI overflow checks."""
    m_hi, m_mid, m_lo = MULTIPLIER >> 32, (MULTIPLIER >> 16) & _M16, MULTIPLIER & _M16
    mid = lo * m_mid
    low = lo * m_lo + F.shiftleft(mid.bitwiseAND(_M16), 16) + 1
    high = (F.shiftright(mid, 16) + F.shiftright(low, 32) + (lo * m_hi).bitwiseAND(_M32)
            + hi * m_lo + F.shiftleft((hi * m_mid).bitwiseAND(_M16), 16))
    return high.bitwiseAND(_M32), low.bitwiseAND(_M32)


def jumps(key: Column, shards: int) -> Column:
    """struct(shard, next): the shard among `shards`, and the first jump target at or
    beyond that number.  With one more shard a row moves exactly if next = shards."""
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_M32).alias("lo"),
                     F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _advance(acc["hi"], acc["lo"])
        landed = F.floor((acc["next"] + 1).cast("double")
                         * (F.lit(float(RANGE)) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(acc["next"] >= shards, acc).otherwise(
            F.struct(hi.alias("hi"), lo.alias("lo"), acc["next"].alias("shard"), landed.alias("next")))

    # Each jump goes at least one shard further, so `shards` steps are always enough.
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return F.struct(end["shard"].cast("int").alias("shard"), end["next"].alias("next"))


def assign(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with `shard` and `grown_shard` (the shard if one more were appended).  The
    integer key alone decides; a null key counts as 0; equal keys share a shard."""
    at = jumps(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), shards)
    return df.withColumn("_at", at).withColumns({
        "shard": F.col("_at.shard"),
        "grown_shard": F.when(F.col("_at.next") == shards, F.lit(shards)).otherwise(F.col("_at.shard"))}).drop("_at")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (null text: 0), law `key`,
    shard, slot, grown_shard for every row of docs.

    Slots count from 0 in each shard by doc_id (nulls first), checksum and size; rows equal
    in all of these are interchangeable.  They come from one range sort over all shards, so
    neither a shard nor a repeated key is numbered by one task.  Of a very long text only the
    size and the checksum travel.  Other columns are ignored;
    an empty table gives none.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = settle(assign(small, "doc_id", shards), "shards")
    # `shards` rows at most: how many rows the shards before each one hold.
    counts = placed.groupBy("shard").agg(F.count("*").alias("_c"))
    later = counts.select(F.explode(F.sequence("shard", F.lit(shards - 1))).alias("_s"), "shard", "_c")
    starts = later.groupBy(F.col("_s").alias("shard")).agg(
        F.coalesce(F.sum(F.when(F.col("shard") < F.col("_s"), F.col("_c"))), F.lit(0)).alias("_start"))
    order = ["shard", "doc_id", "text_crc32", "size", "_row"]
    ranked = numbered(placed.withColumn("_row", F.monotonically_increasing_id()), order, "_n")
    return ranked.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_n") - F.col("_start")).alias("slot"), "grown_shard")
