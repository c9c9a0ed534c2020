"""Weighted rendezvous sharding with a gapless slot for every row.

Each shard draws a number in (0, 1) from the record key and its own name; the
shard of the least ``-ln(draw) / weight`` takes the record. A new shard only
takes records for which its own score is the least, and no record moves
between old shards. Built-in functions only.

Slots number the rows of a shard from 0. Rows are dealt into many buckets of a
shard by a hash of the row and its place in the input, numbered within the
bucket, and moved up by the counts of the buckets before it; so no task holds a
whole shard, nor all copies of a row. Which row of a shard has which slot is
not stated: another run may number them otherwise.

Null keys hash as a key of their own; null texts have size 1 and checksum 0;
texts of any length are measured whole; of equal scores the shard named first
wins; repeated rows share a shard and have different slots; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Rows of one bucket on average, and buckets of a shard at most (their counts are broadcast while they are few).
BUCKET_ROWS, MOST_BUCKETS = 50_000, 65_536
#: Draws are 52 bits of a hash.
DRAW = float(1 << 52)


def score(key: Column, shard: int, weight: float) -> Column:
    """What the shards compete with: exponential draws, the least wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard {shard}")), 12)
    return -F.log((bits.cast("double") + 0.5) / DRAW) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (its place in ``weights``) of a key; shards of weight 0 take nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard of positive weight is needed")
    scores = [F.struct(score(key, i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["i"]


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``grown`` holds the weights after the change of the shard count; by default
    one more shard of the mean weight.
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"))
    rows = rows.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"))
    # the place parts copies of a row; it is written, so that counting and numbering see the same
    spread = F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())
    rows = common.materialise(rows.withColumn("spread", F.pmod(spread, F.lit(1 << 30)).cast("int")), "shards")
    buckets = min(MOST_BUCKETS, max(64, rows.count() // len(weights) // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("spread", F.lit(buckets))).drop("spread")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(within).cast("long") - 1)
    numbered = common.join_small(numbered, starts, ["shard", "bucket"], "inner", buckets * len(weights), 24)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), "grown_shard")


def query(spark, sf_dir):
    return shard(common.table(spark, sf_dir, "documents"), [1.0] * 8)
