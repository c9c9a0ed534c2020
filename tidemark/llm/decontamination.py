"""Benchmark decontamination: every training passage asks a BM25 index of test items.

The index holds, for each term, the items it occurs in with their BM25 weight
divided by the item's score against itself, so a score of 1 stands for the
whole item. Posting lists are cut into blocks of items; block-max WAND walks
them and returns every item that scores at least the threshold. A
passage whose distinct terms can't reach it even with each term's greatest weight is
passed over before the walk; that bound is computed for whole texts at once.

A retrieved item is then verified: shares of the five-word shingles of its
question (all but the last third of its words) and of its answer (that third)
that occur among the words around the passage.

Item frequencies and the mean length are those of the whole benchmark, whatever
it is cut into. Items of like length share an index of their own, whose
passages are two times its longest item and overlap by half, so every item lies
whole in one of them and a long item doesn't lengthen the passages that others
are sought in. Indices come in parts of bounded text, broadcast one after the
other; with several parts texts are read once for each. The driver holds one
part, and the number of items of each distinct word of the benchmark.

Rows of one item_id are one item's versions: the best is reported. Nulls and
empty texts, and items without words, match nothing; texts of any length are
read whole, a bounded number of words at once; of passages with equal scores
the first is reported; repeated rows match each; ids may be of any type; other
columns aren't read; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: What a word is. Words are compared with case folded, without outer punctuation.
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: BM25's constants.
K1, B = 1.2, 0.75
#: Least score (of the item's own), and least shares of question and answer shingles.
THRESHOLD, QUESTION, ANSWER = 0.6, 0.6, 0.5
SHINGLE = 5
#: Items of a block; characters of benchmark text of one part of the index.
BLOCK, PART_CHARS = 8, 4 << 20
#: Ranges of items with a bound of their own, half passages bounded at once, and words summed at once.
RANGES, HALVES, WORDS_AT_ONCE = 100, 2000, 1 << 14
#: Items of up to so many words share an index, then of up to CLASS_STEP times as many, and so on.
FIRST_CLASS, CLASS_STEP = 128, 8
#: What sums of bounds may lack of the threshold, as they are of single precision.
SLACK = 1e-4


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def shingles(w: list[str]) -> set[tuple]:
    n = min(SHINGLE, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def length_class(n: int) -> int:
    """The greatest length of the items that share an index with one of n words."""
    most = FIRST_CLASS
    while n > most:
        most *= CLASS_STEP
    return most


class Statistics:
    """Of all items of a benchmark: how many have words, their mean length, how many hold each word, and the longest of each class of lengths."""

    def __init__(self, items):
        self.n, total, self.df, self.longest = 0, 0, Counter(), Counter()
        for _, text in items:
            if w := words(text or ""):
                self.n += 1
                total += len(w)
                self.df.update(set(w))
                self.longest[length_class(len(w))] = max(self.longest[length_class(len(w))], len(w))
        self.mean = total / max(1, self.n)

    def idf(self, term: str) -> float:
        k = self.df[term]
        return math.log(1 + (self.n - k + 0.5) / (k + 0.5))


class Index:
    def __init__(self, items: list[tuple], known: Statistics | None = None):
        known = known or Statistics(items)
        self.items = [(i, w) for i, t in items if (w := words(t or ""))]
        n = len(self.items)
        counts = [Counter(w) for _, w in self.items]
        idf = {t: known.idf(t) for c in counts for t in c}
        self.term = {t: k for k, t in enumerate(sorted(idf))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for place, c in enumerate(counts):
            long = K1 * (1 - B + B * len(self.items[place][1]) / known.mean)
            weight = {t: idf[t] * f * (K1 + 1) / (f + long) for t, f in c.items()}
            own = sum(weight.values())
            for t, x in weight.items():
                lists[self.term[t]].append((place, x / own))
        self.postings = [[p for p, _ in x] for x in lists]
        self.weights = [[w for _, w in x] for x in lists]
        self.most = np.array([max(x) for x in self.weights] or [0.0])
        wide = -(-n // RANGES) or 1
        self.range_most = np.zeros((len(self.term), -(-n // wide) or 1), np.float32)
        for t, (p, x) in enumerate(zip(self.postings, self.weights)):
            np.maximum.at(self.range_most[t], np.array(p) // wide, x)
        # of each block: the last item in it and its greatest weight
        self.block_last = [[x[min(k + BLOCK, len(x)) - 1] for k in range(0, len(x), BLOCK)] for x in self.postings]
        self.block_most = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.weights]
        self.parts = []
        for _, w in self.items:
            cut = len(w) - max(1, len(w) // 3) if len(w) > 1 else len(w)
            self.parts.append((shingles(w[:cut]), shingles(w[cut:])))
        self.longest = max((known.longest[length_class(len(w))] for _, w in self.items), default=0)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (place, score) of at least the threshold, by block-max WAND. terms: distinct."""
        end = len(self.items)
        lists = [(self.postings[t], self.weights[t], self.block_last[t], self.block_most[t], float(self.most[t])) for t in terms]
        at = [0] * len(lists)
        doc = [x[0][0] for x in lists]
        order = list(range(len(lists)))
        out = []
        bound = threshold - 1e-9

        def advance(k: int, to: int) -> None:
            """Move list k to the first item of at least ``to``, a block at a time."""
            posting, last, i = lists[k][0], lists[k][2], at[k]
            block = i // BLOCK
            while block < len(last) and last[block] < to:
                block += 1
            i = max(i, block * BLOCK)
            while i < len(posting) and posting[i] < to:
                i += 1
            at[k], doc[k] = i, posting[i] if i < len(posting) else end

        while True:
            order.sort(key=doc.__getitem__)
            total, pivot = 0.0, -1
            for p, k in enumerate(order):
                if doc[k] >= end:
                    break
                total += lists[k][4]
                if total >= bound:
                    pivot = p
                    break
            if pivot < 0:
                return out
            target = doc[order[pivot]]
            while pivot + 1 < len(order) and doc[order[pivot + 1]] == target:
                pivot += 1
            # what the blocks that may hold the target can give, and the first item beyond one of them
            total, beyond = 0.0, end
            for k in order[: pivot + 1]:
                last, most = lists[k][2], lists[k][3]
                block = at[k] // BLOCK
                while block < len(last) and last[block] < target:
                    block += 1
                if block < len(last):
                    total += most[block]
                    beyond = min(beyond, last[block] + 1)
            if total < bound:
                if pivot + 1 < len(order):
                    beyond = min(beyond, doc[order[pivot + 1]])
                beyond = max(beyond, target + 1)
                for k in order[: pivot + 1]:
                    if doc[k] < beyond:
                        advance(k, beyond)
            elif doc[order[0]] == target:
                score = sum(lists[k][1][at[k]] for k in order[: pivot + 1])
                if score >= bound:
                    out.append((target, score))
                for k in order[: pivot + 1]:
                    advance(k, target + 1)
            else:
                for k in order[:pivot]:
                    if doc[k] < target:
                        advance(k, target)

    def candidates(self, ids: np.ndarray, stride: int, threshold: float) -> np.ndarray:
        """Passages (number k: words k * stride to (k + 2) * stride) whose distinct terms could reach the threshold."""
        places = np.flatnonzero(ids >= 0)
        blocks = -(-len(ids) // stride)
        if not len(places):
            return np.empty(0, np.int64)
        terms = ids[places]
        order = np.argsort(terms, kind="stable")
        before = np.full(len(terms), -1)
        same = terms[order][1:] == terms[order][:-1]
        before[order[1:][same]] = places[order[:-1][same]]
        block = places // stride
        fresh = before < block * stride  # new in its half passage
        newer = before < (block - 1) * stride  # new since the start of the half before
        out = []
        for k in range(0, blocks, HALVES):
            first = self.range_sums(terms, block, fresh, k, min(k + HALVES, blocks))
            second = self.range_sums(terms, block, newer, k + 1, min(k + HALVES, blocks) + 1)
            out.append(np.flatnonzero((first + second).max(1) >= threshold - SLACK) + k)
        return np.concatenate(out)

    def range_sums(self, terms: np.ndarray, block: np.ndarray, keep: np.ndarray, low: int, high: int) -> np.ndarray:
        """For half passages low to high, the sum of their kept terms' greatest weights in each range of items."""
        a, b = np.searchsorted(block, [low, high])
        use = np.flatnonzero(keep[a:b]) + a
        sums = np.zeros((high - low, self.range_most.shape[1]), np.float32)
        for k in range(0, len(use), WORDS_AT_ONCE):
            part = use[k : k + WORDS_AT_ONCE]
            at = block[part] - low
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sums[at[starts]] += np.add.reduceat(self.range_most[terms[part]], starts, axis=0)
        return sums

    def leaks(self, w: list[str], best: dict, threshold: float, question: float, answer: float) -> None:
        """Put (item, score, question share, answer share, first word, words) of each item that leaked into a text of the words ``w`` into ``best``, its best passage."""
        stride = max(8, self.longest)
        number = self.term.get
        ids = np.fromiter((number(x, -1) for x in w), np.int64, len(w))
        for k in self.candidates(ids, stride, threshold).tolist():
            a, b = k * stride, (k + 2) * stride
            part = ids[a:b]
            around = None
            for place, score in self.search(np.unique(part[part >= 0]).tolist(), threshold):
                if around is None:
                    near = w[max(0, a - stride) : b + stride]
                    around = {n: {tuple(near[i : i + n]) for i in range(len(near) - n + 1)} for n in range(1, SHINGLE + 1)}
                shares = [sum(s in around[len(s)] for s in side) / len(side) if side else 1.0 for side in self.parts[place]]
                if shares[0] >= question and shares[1] >= answer:
                    item = self.items[place][0]
                    found = (item, score, *shares, a, min(b, len(w)) - a)
                    if item not in best or (score, -a) > (best[item][1], -best[item][4]):
                        best[item] = found


class Part:
    """The indices of some items, one for each class of lengths."""

    def __init__(self, items: list[tuple], known: Statistics | None = None):
        known = known or Statistics(items)
        classes: dict[int, list[tuple]] = {}
        for i, t in items:
            if n := len(words(t or "")):
                classes.setdefault(length_class(n), []).append((i, t))
        self.indices = [Index(classes[k], known) for k in sorted(classes)]

    def leaks(self, text: str | None, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> list[tuple]:
        best: dict = {}
        if text and self.indices:
            w = words(text)
            for index in self.indices:
                index.leaks(w, best, threshold, question, answer)
        return [best[i] for i in sorted(best, key=lambda i: (i is None, str(type(i)), i))]


MEASURES = "score double, question_overlap double, answer_overlap double, first_word long, passage_words long"


def index_parts(benchmark: DataFrame, part_chars: int = PART_CHARS) -> Iterator[Part]:
    """The index of the test items in parts of bounded size, built on the driver one at a time from a stream of rows; rows of one item_id are in one part."""
    rows = benchmark.select("item_id", "text").orderBy("item_id", "text")
    known = Statistics((r["item_id"], r["text"]) for r in rows.toLocalIterator())
    held, size = [], 0
    for r in rows.toLocalIterator():
        if size > part_chars and (r["item_id"] is None or r["item_id"] != held[-1][0]):
            yield Part(held, known)
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
    yield Part(held, known)


def integers(values: pd.Series, kind: str) -> pd.Series:
    return values.astype("Int64") if kind in ("tinyint", "smallint", "int", "bigint") else values.astype(object)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, part_chars: int = PART_CHARS) -> DataFrame:
    """A row for each document and test item that leaked into it: its best passage and the shares found there."""
    spark = docs.sparkSession
    common.text_batches(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, {MEASURES}"
    names = ["doc_id", "item_id", *[x.split()[0] for x in MEASURES.split(", ")]]

    def found_in(part: Part) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(part)

        def run(batches):
            part = sent.value
            for b in batches:
                rows = [(d, *x) for d, t in zip(b["doc_id"], b["text"]) for x in part.leaks(t, threshold, question, answer)]
                frame = pd.DataFrame(rows, columns=names)
                for c, kind in zip(names, kinds):
                    frame[c] = integers(frame[c], kind)
                yield frame

        return docs.select("doc_id", "text").mapInPandas(run, schema), sent

    out, last = None, None
    for part in index_parts(benchmark, part_chars):
        if last is not None:  # one part at a time on the executors
            found, sent = last
            found = common.materialise(found, "leaks")
            sent.destroy()
            out = found if out is None else out.unionByName(found)
        last = found_in(part)
    return last[0] if out is None else out.unionByName(last[0])


def clean(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents without a leaked test item, all columns; rows are judged by their text alone, whatever their id, and go if it leaks."""
    spark = docs.sparkSession
    common.text_batches(spark)

    def without(docs: DataFrame, part: Part) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(part)

        @F.pandas_udf("boolean")
        def leaks(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(sent.value.leaks(t)) for t in texts], dtype=bool)

        return docs.filter(~leaks("text")), sent

    sent = None
    for part in index_parts(benchmark, part_chars):
        if sent is not None:
            docs = common.materialise(docs, "clean")
            sent.destroy()
        docs, sent = without(docs, part)
    return docs


def query(spark, sf_dir):
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
