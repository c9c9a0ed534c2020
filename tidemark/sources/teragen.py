"""Rows of 100 bytes for sort tests: 10 key bytes, a tab, a 10-digit row number, 78 filler bytes, a line end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(row: Column, seed: int = 1) -> Column:
    """Ten printable letters from a hash of the row number."""
    return F.substring(F.translate(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"))), "0123456789abcdef", LETTERS[:16]), 1, 10)


def filler(row: Column) -> Column:
    """Seven runs of ten equal letters and one of eight; the letter moves on with each run and row."""
    letter = lambda k: F.substring(F.lit(LETTERS), (F.pmod(row + k, F.lit(26)) + 1).cast("int"), F.lit(1))
    return F.concat(*[F.repeat(letter(k), 10) for k in range(7)], F.repeat(letter(7), 8))


def rows(spark: SparkSession, n: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """key, row, filler."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select(key(F.col("id"), seed).alias("key"), F.lpad(F.col("id").cast("string"), 10, "0").alias("row"), filler(F.col("id")).alias("filler"))


def write(spark: SparkSession, n: int, path: str, seed: int = 1, partitions: int | None = None) -> None:
    rows(spark, n, seed, partitions).select(F.concat("key", F.lit("\t"), "row", "filler").alias("value")).write.text(path)
