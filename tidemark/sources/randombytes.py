"""Bytes that don't compress, the same for the same seed, for probes of storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def blocks(spark: SparkSession, size: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """block long, data binary: ``size`` bytes in blocks, each from the seed and its number alone, so any block can be made again."""
    n = -(-size // block)
    rows = spark.range(n).withColumnRenamed("id", "block")
    length = F.least(F.lit(block).cast("long"), F.lit(size) - F.col("block") * block).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 32).cast("int")), lambda k: F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"), k.cast("string")).cast("binary"), 256)))
    return rows.select("block", F.substring(F.unhex(F.array_join(F.transform(pieces, F.hex), "")), 1, block).alias("data"), length.alias("length")).select("block", F.expr("substring(data, 1, length)").alias("data"))
