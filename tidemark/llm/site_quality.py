"""Quality classification with hierarchical empirical Bayes over sites.

A logistic classifier gives each document's evidence. Over all documents, the
mean probability of a host is shrunk towards the global mean, and that of a
path towards its host's, each with a Beta prior whose strength comes from the
spread of the group means by the method of moments: where groups differ no
more than chance lets them, the prior is strong and sparse sites keep the
global value. A document's posterior adds its own log odds to the log odds by
which its path departs from the global mean.

The classifier is fitted to a bounded sample of labelled rows
(about ``FIT_ROWS`` of least hash); every count, mean and prior covers all documents.
Groups are summed with partial aggregates, so one host may hold any share.

Null texts count as empty; null hosts and paths are groups of their own;
labels of documents that aren't there, and null labels, are ignored, repeated
ones count each. Without labels of both kinds the evidence is even and all
documents are kept. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled rows that the classifier is fitted to (never over twice as many); its ridge.
FIT_ROWS, RIDGE = 20_000, 1.0
#: Documents of a posterior under this are rejected.
LEAST_POSTERIOR = 0.5
#: Weight of the site's log odds in a document's posterior, and the greatest prior strength.
SITE_WEIGHT, MOST_STRENGTH = 1.0, 1e6

FEATURES = ["log_words", "symbol_share", "symbol_words", "repeat_next", "distinct_share", "upper_share", "digit_share", "mean_word", "top_word", "dup_lines", "short_text", "repeat_skip"]
_symbol = re.compile(r"[#*$%&|<>!~^={}\[\]\\@_]")
_upper = re.compile(r"[A-Z]")
_digit = re.compile(r"[0-9]")


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    chars = max(1, len(text))
    symbols = len(_symbol.findall(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(words)),
        min(1.0, 5 * symbols / chars),
        min(1.0, symbols / n),
        sum(map(str.__eq__, words, words[1:])) / n,
        len(counts) / n if words else 1.0,
        len(_upper.findall(text)) / chars,
        len(_digit.findall(text)) / chars,
        min(20.0, chars / n) / 10,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(len(words) < 10),
        sum(map(str.__eq__, words, words[2:])) / n,
    ]


def evidence_features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in texts])

    return run(text)


class Logistic:
    """Ridge logistic regression on standardised features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], RIDGE)
        ridge[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w[1:] / self.scale
        self.b = float(w[0] - self.mean @ self.w)

    def log_odds(self, f: Column) -> Column:
        return F.lit(self.b) + sum((F.lit(float(w)) * f[k] for k, w in enumerate(self.w)), F.lit(0.0))


def fit(rows: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Logistic | None:
    """rows: doc_id, f. labels: doc_id, quality (1 good)."""
    known = rows.select("doc_id", "f").join(labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality"), "doc_id")
    drawn = common.least_hashes(known, F.xxhash64("doc_id", "quality"), most, labels.count())
    got = drawn.select(F.xxhash64("doc_id", "quality").alias("h"), "f", (F.col("quality") > 0).cast("double").alias("y")).toPandas().sort_values(["h", "y"], kind="stable")
    if got["y"].nunique() < 2:
        return None
    return Logistic(np.array(got["f"].tolist()), got["y"].to_numpy())


def moments(groups: DataFrame, n: str, s: str, parent: Column) -> float:
    """The strength (pseudo-documents) of the Beta prior under which group means scatter as they do around their parents."""
    mean = F.col(s) / F.col(n)
    m = F.least(F.greatest(parent, F.lit(1e-6)), F.lit(1 - 1e-6))
    r = groups.agg(
        F.sum(F.col(n)).alias("n"),
        F.sum(F.col(n) * F.pow(mean - m, 2)).alias("between"),
        F.sum(m * (1 - m)).alias("chance"),
        F.sum(F.col(n) * m * (1 - m)).alias("whole"),
    ).first()
    if not r["n"]:
        return MOST_STRENGTH
    # E[between] = chance + rho * (whole - chance), rho = 1 / (strength + 1)
    rho = (r["between"] - r["chance"]) / max(r["whole"] - r["chance"], 1e-9)
    return MOST_STRENGTH if rho <= 1 / MOST_STRENGTH else min(MOST_STRENGTH, 1 / rho - 1 if rho < 1 else 0.01)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def text_or(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\0null"))


def row_key(host: str, path: str) -> Column:
    """A hash of all that a row's verdict follows from, and its id; null and empty texts are alike."""
    return F.xxhash64(text_or("doc_id"), text_or(host), text_or(path), F.coalesce("text", F.lit("")))


def judge(docs: DataFrame, labels: DataFrame, host: str, path: str, least: float) -> DataFrame:
    """What ``classify`` gives, and the key of every row."""
    common.text_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or(host).alias("host"), text_or(path).alias("path"), row_key(host, path).alias("key"), evidence_features(F.col("text")).alias("f"))
    rows = common.materialise(rows, "features")
    model = fit(rows, labels)
    evidence = model.log_odds(F.col("f")) if model else F.lit(0.0)
    rows = rows.select("doc_id", "host", "path", "key", F.least(F.greatest(evidence, F.lit(-30.0)), F.lit(30.0)).alias("evidence"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = common.materialise(rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("groups")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    of_host = moments(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.select("host", ((F.col("hs") + of_host * mean) / (F.col("hn") + of_host)).alias("host_posterior"))
    few = whole["groups"] <= common.BROADCAST_ROWS
    paths = paths.join(F.broadcast(hosts) if few else hosts, "host")
    of_path = moments(paths, "n", "s", F.col("host_posterior"))
    paths = paths.select("host", "path", "host_posterior", ((F.col("s") + of_path * F.col("host_posterior")) / (F.col("n") + of_path)).alias("path_posterior"))
    out = common.join_small(rows, paths, ["host", "path"], "left", whole["groups"])
    site = logit(F.col("path_posterior")) - logit(F.lit(mean))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + SITE_WEIGHT * site))))
    kept = F.col("posterior") >= least if model else F.lit(True)
    return out.select("doc_id", "host", "path", "key", "evidence", "host_posterior", "path_posterior", "posterior", kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = LEAST_POSTERIOR) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, posterior, kept of every row."""
    return judge(docs, labels, host, path, least).drop("key")


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, all columns; a row goes by its own id, host, path and text, so null and repeated ids don't take others with them."""
    bad_key = common.free_name(docs, "bad_key")
    bad = judge(docs, labels, host, path, LEAST_POSTERIOR).filter(~F.col("kept")).select(F.col("key").alias(bad_key)).distinct()
    bad = common.materialise(bad, "rejected")
    few = bad.count() <= common.BROADCAST_ROWS
    return docs.join(F.broadcast(bad) if few else bad, row_key(host, path) == F.col(bad_key), "left_anti")


def query(spark, sf_dir):
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
