"""What the operators of this subpackage share: tables, shared storage, names."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import BROADCAST_BYTES, BROADCAST_ROWS, delete, materialise, release, shared_dir, shared_path, small

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "delete", "free_name", "give_back", "join_small", "least_hashes", "materialise", "release", "shared_dir", "shared_path", "small", "table", "text_batches", "tokenizer_path"]

#: Rows and bytes of text in one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores as long as the frame has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, in rows and bytes: a worker holds one batch at a time. Lower settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key, None) or "0").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return to the system what a Python worker's allocators hold but don't use: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, bytes_each: int = 64) -> DataFrame:
    """Join with a broadcast while ``right`` is small in rows and bytes, else with a shuffle."""
    return left.join(small(right, rows, bytes_each), on, how)


def least_hashes(df: DataFrame, hashed: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` rows of least hash, never more than twice that, out of ``total``.

    A threshold on the hash goes first, so tasks hand on their share only,
    however many tasks there are.
    """
    if total <= rows:
        return df
    return df.filter(F.pmod(hashed, F.lit(1 << 40)) < F.lit(int((1 << 40) * rows / total))).limit(2 * rows)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies: ``TIDEMARK_TOKENIZERS``, else the installed package."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
