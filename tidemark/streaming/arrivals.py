"""Segments from rows that are still arriving: each micro-batch is sorted into the segments of fixed bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.sort import SEGMENT, SortSpec, sort_segments


def write_arriving(stream: DataFrame, spec: SortSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch as sorted runs, one file in a folder of its own for each batch and segment; a batch that is run again replaces its own."""
    if spec.bounds is None:
        raise ValueError("a stream needs given bounds")

    def batch(rows: DataFrame, number: int) -> None:
        sort_segments(rows, spec).write.mode("overwrite").partitionBy(SEGMENT).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark, path: str, spec: SortSpec) -> DataFrame:
    """All runs so far as one sorted table of segments."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop(SEGMENT, "batch")
    return sort_segments(rows, spec)
