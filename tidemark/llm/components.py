"""Connected components of a link table, by alternating star contractions.

Every round only takes minima per node and joins them back, so no group is
gathered; each round is written to shared storage, where lost executors
can't undo it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def star_roots(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every linked node but the roots. links: a long, b long. An empty table gives an empty one."""
    spark, last = links.sparkSession, None

    def written(edges: DataFrame) -> DataFrame:
        """The round on shared storage; the round before it is deleted, as nothing reads it any more."""
        nonlocal last
        path = common.shared_path(spark, "links")
        edges.write.parquet(path)
        if last:
            common.delete(spark, last)
        last = path
        return spark.read.schema("a long, b long").parquet(path)

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = signature(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").filter("a <> b").distinct())
        if (now := signature(edges)) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
