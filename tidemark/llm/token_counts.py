"""Token counts without token ids: initial symbols minus merges.

A column operator: no shuffle, no state beyond a bounded cache of pieces in
each worker. Nulls and empty texts count 0; texts of any length are split in
bounded spans; repeated rows are counted each; other columns aren't read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, common


def count_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens of each text under the byte-level vocabulary file, as long."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        bpe = byte_bpe.load(vocabulary)
        return pd.Series([0 if x is None else bpe.n_tokens(x) for x in texts], dtype="int64")

    return tokens(text)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document."""
    common.text_batches(docs.sparkSession)
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        count_tokens(F.col("text"), vocabulary).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir):
    return token_counts(common.table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"))
