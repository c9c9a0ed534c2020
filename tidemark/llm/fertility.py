"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per
token, the share of tokens that are fallback bytes, and the entropy of its
tokens. Each language, or where none is given each dominant script, has a band
of its own: ``WIDTH`` median absolute deviations around the median of all its
documents that pass the base rules. Medians and deviations of a group of n are
shrunk to those of all documents with the weight n / (n + ``SHRINK``), so a
sparse group has nearly the common band and a large one its own. For texts of
fewer tokens than the group's median the band widens with the square root of
the ratio, as chance does. Outside a band a text is rejected. Floors only stand
in where the deviations are next to nothing.

Null and empty texts have no words and fail the base rules; texts of any length
are measured whole; a value at a band's edge is inside; repeated rows count
each; an empty table gives an empty result; other columns, whatever their names,
aren't read. A group's rows are only counted and ranked with partial aggregates,
so one language may hold any share of them. Ranks are exact to one in
``RANKS`` rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, common

#: What a word is, and the symbols that are counted.
WORD, SYMBOLS = re.compile(r"[^\x20\x09-\x0D]+"), "#*$%&|<>"
#: Half widths of the bands in median absolute deviations, and their floors.
WIDTH = 6.0
FLOORS = {"chars_per_token": 0.02, "fallback_share": 0.05, "token_entropy": 0.1}
#: Documents of a group that weigh as much as those of all.
SHRINK = 50.0
#: Accuracy of ranks.
RANKS = 10_000
#: First and last code points of scripts, by which texts without a language are grouped.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]

MEASURES = list(FLOORS)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_sp_tokens long, chars_per_token double, fallback_share double, token_entropy double"


class Pieces:
    """What each word is split into by a sentencepiece vocabulary, with a bounded cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.known = byte_bpe.Kept(self.split, 200_000)

    def split(self, word: str) -> bytes:
        """The ids, each as four bytes, so that those of many words are joined at once."""
        return array("i", self.sp.encode(word)).tobytes()


def repeated_words(words: list[str], counts: Counter) -> int:
    """Words in windows of three that occur twice or more, each word once."""
    n = len(words) - 2
    if n < 2:
        return 0
    m = len(counts)
    number = dict(zip(counts, range(m)))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if m < 2_000_000:
        keys = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:  # three numbers don't fit into 63 bits
        keys = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1] * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n + 2, bool)
    for k in range(3):
        hit[k : k + n] |= twice
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


def measure(text: str | None, pieces: Pieces) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    counts = Counter(words)
    total = fallback = 0
    entropy = 0.0
    if counts:
        got = list(map(pieces.known.__getitem__, counts))
        times = np.fromiter(counts.values(), np.int64, len(counts))
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids = np.frombuffer(b"".join(got), np.int32)
        each = np.repeat(times, sizes)
        total = int(each.sum())
        if total:
            fallback = int(each[pieces.fallback[ids]].sum())
            found, place = np.unique(ids, return_inverse=True)
            p = np.bincount(place, each, len(found)) / total
            entropy = float(-(p * np.log2(p)).sum())
    chars = sum(map(len, words))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words, counts), total, chars / total if total else 0.0, fallback / total if total else 0.0, entropy)


def script(text: str | None) -> str:
    """The script that most letters of a text are of; ``other`` for scripts not listed and texts without letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    counts = [int(((points >= low) & (points <= high)).sum()) for _, low, high in SCRIPTS]
    # latin's range holds a few signs between its letters
    best = max(range(len(SCRIPTS)), key=lambda k: (counts[k], -k))
    return SCRIPTS[best][0] if counts[best] else "other"


def measures(docs: DataFrame, vocabulary: str, group: str = "lang") -> DataFrame:
    """doc_id, band_group and the measures of every document."""
    common.text_batches(docs.sparkSession)
    loaded: dict[str, Pieces] = {}

    @F.pandas_udf(f"band_group string, {SCHEMA}")
    def run(texts: pd.Series, groups: pd.Series) -> pd.DataFrame:
        if vocabulary not in loaded:
            loaded[vocabulary] = Pieces(vocabulary)
        rows = [(f"script {script(x)}" if pd.isna(g) else f"group {g}", *measure(x, loaded[vocabulary])) for x, g in zip(texts, groups)]
        return pd.DataFrame(rows, columns=["band_group", *[c.split()[0] for c in SCHEMA.split(", ")]])

    return docs.select("doc_id", run("text", F.col(group).cast("string")).alias("m")).select("doc_id", "m.*")


def middles(rows: DataFrame, by: list[str], columns: list) -> DataFrame:
    """The number of rows and the medians of the columns, with partial aggregates."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, 0.5, RANKS).cast("double").alias(name) for name, c in columns])


def bands(rows: DataFrame) -> tuple[DataFrame, int]:
    """band_group, and the middle and deviation of each measure and the middle number of tokens, shrunk; and the number of groups. rows: those that pass the base rules."""
    what = [*MEASURES, "n_sp_tokens"]
    own = common.materialise(middles(rows, ["band_group"], [(f"{m}_own", F.col(m)) for m in what]), "middles")
    groups = own.count()
    every = middles(rows, [], [(m, F.col(m)) for m in what]).first()
    weight = F.col("n") / (F.col("n") + SHRINK)
    mix = lambda c, all_: weight * F.col(c) + (1 - weight) * F.lit(float(all_ or 0.0))
    middle = own.select("band_group", "n", *[mix(f"{m}_own", every[m]).alias(f"{m}_middle") for m in what])
    middle = common.materialise(middle, "middles")
    # deviations are taken within groups, so the common ones don't hold the distances between languages
    off = common.join_small(rows, middle.drop("n"), ["band_group"], "inner", groups)
    far = [(f"{m}_off", F.abs(F.col(m) - F.col(f"{m}_middle"))) for m in MEASURES]
    wide = middles(off, ["band_group"], far).drop("n")
    common_off = middles(off, [], far).first()
    out = middle.join(wide, "band_group", "left")
    out = out.select("band_group", F.col("n_sp_tokens_middle").alias("tokens_middle"), *[f"{m}_middle" for m in MEASURES], *[mix(f"{m}_off", common_off[f"{m}_off"]).alias(f"{m}_deviation") for m in MEASURES])
    return common.materialise(out, "bands"), groups


def fertility_rules(docs: DataFrame, vocabulary: str, group: str = "lang") -> DataFrame:
    """Base counts, measures, base_failed and kept of every document."""
    rows = measures(docs, vocabulary, group)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = common.materialise(rows, "fertility")
    own, groups = bands(rows.filter(~F.col("base_failed")))
    out = common.join_small(rows, own, ["band_group"], "left", groups)
    stretch = F.sqrt(F.greatest(F.lit(1.0), F.col("tokens_middle") / F.greatest(F.col("n_sp_tokens"), F.lit(1))))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.abs(F.col(m) - F.col(f"{m}_middle")) <= F.greatest(F.lit(FLOORS[m]), WIDTH * stretch * F.col(f"{m}_deviation")))
    # a group without a band has no document that passes the base rules
    return out.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False))).drop(*own.columns[1:])


def query(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = fertility_rules(docs, common.tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "token_entropy")
