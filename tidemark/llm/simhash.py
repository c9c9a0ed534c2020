"""SimHash near-duplicates: fingerprints linked within a Hamming radius, exactly, by vantage-point trees.

Equal fingerprints are grouped first. A vantage-point tree over a sample of the
distinct ones (``SAMPLE_EACH`` for each cell) cuts fingerprint space into cells
of about ``CELL``: a fingerprint is at home in one cell, and visits those where
the triangle inequality leaves room for a neighbour within the radius. In each
cell the tree is carried on in memory, pruned by the same bounds, and only a
spanning forest of the links is handed on; components are then found by star
contractions. The number of cells follows the number of fingerprints up to what
``MOST_SAMPLE`` sampled ones can part (1.3 thousand million fingerprints);
beyond, cells grow in proportion and results stay the same.

A crowd of near copies would put everything into a few cells. Fingerprints of
the sample around which many others lie become hubs: what lies within the
radius of a hub is linked to it at once and only visits cells, and the
visitors of a crowded cell are spread over several copies of its residents.

Null and empty texts have fingerprint zero and are linked like any other; texts
of any length are read whole. Rows of one doc_id are one document, so what they
are linked to is linked; rows without an id are documents of their own, with a
null component if no id is reached. Among equal distances there is nothing to
choose. An empty table gives an empty result; other columns aren't read.

``keep_one`` links only what it has verified: texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more. Their fingerprints differ in
ten bits on average, and at such a radius the triangle inequality prunes next
to nothing, since nearly all fingerprints lie 24 to 40 bits from any vantage
point. So the shards of this search come from the shingle sets: texts that share
three least hashes in one of ``BANDS`` bands meet in a shard (0.99999 of the
pairs at 0.8 do), where vantage-point trees find those within the radius. Pairs
that share too few least hashes to be at 0.8 (by five standard deviations) aren't
verified.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidemark.llm import common
from tidemark.llm.components import star_roots

#: Words of a shingle, hash seed, greatest distance of a link.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Of keep_one: words of a verified shingle, least Jaccard similarity of a link, greatest distance searched.
WORDS, SIMILARITY, REACH = 5, 0.8, 18
#: Of keep_one: bands, and least hashes of each; pairs of one text that are verified in a task.
BANDS, BAND, PAIRS_EACH = 16, 3, 500
#: Of keep_one: least hashes (of all bands) that two texts share at least, 38 on average at 0.8; rounds of comparing with one text of a shard.
AGREE, ROUNDS = 24, 3
#: Of keep_one, before a pair found in a whole shard is verified: least hashes kept, and shared at least (410 on average at 0.8, deviation 9).
WIDE, WIDE_AGREE = 512, 373
#: Of keep_one: shingles of the sets of a block or part of a shard, about; sets verified at once against another.
SET_SIZES, VERIFIED_AT_ONCE = 4_000_000, 64
#: Fingerprints of a cell at home on average; fewest cells; sampled fingerprints for each cell and at most.
CELL, LEAST_CELLS, SAMPLE_EACH, MOST_SAMPLE = 20_000, 48, 64, 1 << 22
#: Rows of a frame that a task hands on.
FRAME = 100_000
#: A hub has at least this share of the sample within the radius; hubs at most; points compared to find them.
HUB_SHARE, MOST_HUBS, HUB_SAMPLE = 0.004, 64, 4096
#: Residents under which a cell's tree ends, and residents compared at once; others, or pairs, compared with these at once (a few MB).
LEAF, OTHERS = 192, 1 << 12
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15
#: Node ids from here up stand for fingerprints without a document id.
NO_ID = (1 << 63) - (1 << 41)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    if n <= 1:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, n)


def fingerprint(text: str | None) -> int:
    """The fingerprint, as a signed 64-bit number."""
    return fingerprint_of(shingle_hashes(text) if text else np.empty(0, np.uint64))


def fingerprint_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    most = 2 * bits_of(h) > len(h)
    return int(np.packbits(most, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long."""
    common.text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x) for x in texts], dtype="int64")

    return docs.select("doc_id", run("text").alias("fp"))


def distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(v))


@dataclass
class Node:
    vantage: int = 0
    middle: int = 0  # what is at most this far from the vantage point goes left
    left: Node | None = None
    right: Node | None = None
    cell: int = -1


def split(x: np.ndarray, rng: np.random.Generator, radius: int = RADIUS) -> tuple[int, int] | None:
    """A vantage point and a middle distance with few points just beyond it; None if nothing parts the points."""
    best = None
    for v in rng.choice(x, min(6, len(x)), replace=False):
        counts = np.cumsum(np.bincount(distance(x, v), minlength=65 + radius))
        for m in np.unique(np.searchsorted(counts, len(x) * np.array([0.3, 0.4, 0.5, 0.6, 0.7]))):
            m = min(int(m), 63)
            here, beyond = counts[m], counts[min(m + radius, 64)] - counts[m]
            near = counts[m] - (counts[m - radius] if m >= radius else 0)
            if 0 < here < len(x):
                cost = max(here, len(x) - here) + beyond + 0.5 * near
                if best is None or cost < best[0]:
                    best = (cost, int(v), m)
    return best and best[1:]


def grow(x: np.ndarray, cells: int, rng: np.random.Generator, names: list[int]) -> Node:
    if cells > 1 and len(x) > 1 and (found := split(x, rng)):
        v, m = found
        d = distance(x, v)
        left = round(cells * (d <= m).mean()) or 1
        left = min(left, cells - 1)
        return Node(v, m, grow(x[d <= m], left, rng, names), grow(x[d > m], cells - left, rng, names))
    names.append(len(names))
    return Node(cell=names[-1])


def route(node: Node, x: np.ndarray, at: np.ndarray, home: np.ndarray, out: list) -> None:
    """Put (cell, places in x, whether at home) of every cell that the points ``at`` reach into ``out``."""
    if not len(at):
        return
    if node.cell >= 0:
        out.append((node.cell, at, home))
        return
    d = distance(x[at], node.vantage).astype(np.int16)
    inner = d <= node.middle
    go = (d <= node.middle + RADIUS) & (inner | home) | ~home & (d <= node.middle + RADIUS)
    route(node.left, x, at[go], (home & inner)[go], out)
    go = np.where(home, ~inner, d > node.middle - RADIUS)
    route(node.right, x, at[go], home[go], out)


def find_hubs(x: np.ndarray, radius: int = RADIUS, apart: int = 3 * RADIUS) -> np.ndarray:
    """Points with many others within the radius, too far apart for their neighbourhoods to be linked."""
    x = x[:HUB_SAMPLE]
    near = np.array([(distance(x, v) <= radius).sum() for v in x]) if len(x) else np.empty(0)
    hubs: list[int] = []
    for k in np.argsort(-near, kind="stable"):
        if near[k] < max(8, HUB_SHARE * len(x)) or len(hubs) == MOST_HUBS:
            break
        if all(int(distance(x[k : k + 1], h)[0]) > apart for h in hubs):
            hubs.append(int(x[k]))
    return np.array(hubs, np.uint64)


def hub_of(x: np.ndarray, hubs: np.ndarray) -> np.ndarray:
    """The place of the one hub within the radius of each point, or -1."""
    out = np.full(len(x), -1)
    for k, h in enumerate(hubs):
        out[distance(x, h) <= RADIUS] = k
    return out


class Forest:
    """Union-find over arrays; roots are the least places."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[i]
            if (up == i).all():
                return i
            i = up

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.roots(i), self.roots(j)
            low, high = np.minimum(i, j), np.maximum(i, j)
            keep = low != high
            if not keep.any():
                return
            i, j = low[keep], high[keep]
            np.minimum.at(self.parent, j, i)


def close_pairs(x: np.ndarray, home: np.ndarray, radius: int = RADIUS, seed: int = 7):
    """Places (i, j), as arrays, of all points within the radius of each other, at least one of them at home."""
    rng = np.random.default_rng(seed)
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        own, guests = stack.pop()
        if not len(own):
            continue
        found = split(x[own], rng, radius) if len(own) > LEAF else None
        if found is None:
            for k in range(0, len(own), LEAF):
                part = own[k : k + LEAF]
                others = np.concatenate([own[k:], guests])
                for o in range(0, len(others), OTHERS):
                    other = others[o : o + OTHERS]
                    i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[other][None, :]) <= radius)
                    yield part[i], other[j]
            continue
        v, m = found
        d, dg = distance(x[own], v).astype(np.int16), distance(x[guests], v).astype(np.int16)
        stack.append((own[d <= m], np.concatenate([own[(d > m) & (d <= m + radius)], guests[dg <= m + radius]])))
        stack.append((own[d > m], guests[dg > m - radius]))


def link_cell(x: np.ndarray, home: np.ndarray, forest: Forest, seed: int = 7) -> None:
    """Unite all points within the radius of each other, at least one of them at home."""
    for i, j in close_pairs(x, home, RADIUS, seed):
        forest.union(i, j)


def links(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """a, b: links of nodes whose fingerprints lie within the radius, enough of them to connect all that are connected. nodes: fp long (distinct), node long."""
    n = nodes.count()
    cells = int(min(MOST_SAMPLE // SAMPLE_EACH, max(LEAST_CELLS, n // cell)))
    drawn = common.least_hashes(nodes, F.xxhash64("fp"), min(MOST_SAMPLE, max(HUB_SAMPLE, cells * SAMPLE_EACH)), n)
    sample = drawn.select("fp").toPandas()["fp"].to_numpy(np.int64)
    sample = np.random.default_rng(2).permutation(np.sort(sample)).view(np.uint64)
    hubs = find_hubs(sample)
    free = hub_of(sample, hubs) < 0
    names: list[int] = []
    tree = grow(sample[free] if free.sum() > cells else sample, cells, np.random.default_rng(1), names)
    met: list = []
    route(tree, sample, np.arange(len(sample)), free, met)
    guests = np.zeros(len(names))
    for c, at, home in met:
        guests[c] += (~home).sum()
    each = max(1.0, n / max(1, len(sample)))
    copies = np.maximum(1, np.ceil(guests * each / max(cell / 2, 4 * n / cells))).astype(int)
    sent = nodes.sparkSession.sparkContext.broadcast((tree, hubs, copies))  # a few dozen bytes for each cell

    def deal(batches):
        tree, hubs, copies = sent.value
        for b in batches:
            x = b["fp"].to_numpy(np.int64).view(np.uint64)
            node = b["node"].to_numpy(np.int64)
            out: list = []
            route(tree, x, np.arange(len(x)), hub_of(x, hubs) < 0, out)
            spread = x % np.uint64(9973)
            held, rows = [], 0
            for c, at, home in out:
                k = copies[c]
                for salt in range(k):
                    go = home | (spread[at] % np.uint64(k) == salt) if k > 1 else slice(None)
                    held.append((np.full(len(at[go]), c, np.int32), np.full(len(at[go]), salt, np.int32), at[go], home[go]))
                    rows += len(at[go])
                    if rows > FRAME:
                        yield dealt_frame(held, x, node)
                        held, rows = [], 0
            if held:
                yield dealt_frame(held, x, node)

    def dealt_frame(held: list, x: np.ndarray, node: np.ndarray) -> pd.DataFrame:
        c, salt, at, home = (np.concatenate(v) for v in zip(*held))
        return pd.DataFrame({"cell": c, "salt": salt, "fp": x[at].view(np.int64), "node": node[at], "home": home})

    def search(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node", kind="stable")
        x, node, forest = b["fp"].to_numpy(np.int64).view(np.uint64), b["node"].to_numpy(np.int64), Forest(len(b))
        link_cell(x, b["home"].to_numpy(bool), forest)
        root = forest.roots(np.arange(len(b)))
        linked = root != np.arange(len(b))
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]]})

    # the table's files are small and few, the work on a row is not: a task for each cell's worth of rows
    dealt = nodes.repartition(cells, "node").mapInPandas(deal, "cell int, salt int, fp long, node long, home boolean")
    found = dealt.groupBy("cell", "salt").applyInPandas(search, "a long, b long")
    if not len(hubs):
        return found
    near = np.array([int(h) for h in hubs.view(np.int64)])
    # hubs are rows of the table: their own node, at most MOST_HUBS of them
    of = {int(r["fp"]): int(r["node"]) for r in nodes.filter(F.col("fp").isin([int(h) for h in near])).collect()}
    ids = [of[int(h)] for h in near]
    hub = F.coalesce(*[F.when(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(h)))) <= RADIUS, F.lit(i)) for h, i in zip(near, ids)])
    return found.unionByName(nodes.select(F.col("node").alias("a"), hub.alias("b")).filter("b is not null and a <> b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    fps = common.materialise(fingerprints(docs), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = nodes.select("fp", F.coalesce("first", F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(1 << 40))).cast("long").alias("node"))
    nodes = common.materialise(nodes, "nodes")
    # rows of one id with several fingerprints are one document
    several = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    several = common.materialise(several.select("doc_id"), "several")
    found = links(nodes)
    if n := several.count():
        theirs = common.join_small(fps, several, ["doc_id"], "inner", n).distinct().join(nodes, "fp")
        least = theirs.groupBy("doc_id").agg(F.min("node").alias("b"))
        found = found.unionByName(theirs.join(least, "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b"))
    roots = star_roots(found)
    roots = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    out = fps.join(roots, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))


_rng = np.random.default_rng(20240707)
_factors = _rng.integers(0, 2**64, WIDE, dtype=np.uint64) | np.uint64(1)
_marks = _rng.integers(0, 2**64, WIDE, dtype=np.uint64)
_mix = _rng.integers(0, 2**64, (BANDS, BAND), dtype=np.uint64) | np.uint64(1)


def least_of(h: np.ndarray, count: int) -> np.ndarray:
    """The least of each of so many hashes over a set."""
    least = np.full(count, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 1024):
        np.minimum(least, ((h[None, k : k + 1024] ^ _marks[:count, None]) * _factors[:count, None]).min(1), out=least)
    return least ^ least >> np.uint64(29)


def sketch(least: np.ndarray) -> bytes:
    return (least >> np.uint64(20)).astype(np.uint8).tobytes()


def band_keys(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band, from its least hashes over the set, and a byte of each least hash; none for an empty set."""
    if not len(h):
        return np.empty(0, np.int64), b""
    least = least_of(h, BANDS * BAND)
    return keys_of(least), sketch(least)


def keys_of(least: np.ndarray) -> np.ndarray:
    keys = (least.reshape(BANDS, BAND) * _mix).sum(1, dtype=np.uint64)
    return (keys ^ keys >> np.uint64(31)).view(np.int64)


def sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


@F.pandas_udf(IntegerType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many least hashes two texts share."""
    return pd.Series((sketches(a) == sketches(b)).sum(1).astype(np.int32))


# a filter on it would be pushed below the column and compute it again, in a second Python worker of each task
agreement = agreement.asNondeterministic()


def distinct_sets(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, row_hash, digest of every row; and of each distinct shingle set: node (its digest), fp, n (its size), text_hash, keys, sketch."""
    common.text_batches(docs.sparkSession)

    @F.pandas_udf("fp long, node long, n long, keys array<long>, sketch binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            h = shingle_hashes(x, shingle) if x else np.empty(0, np.uint64)
            s = np.unique(h)
            rows.append((fingerprint_of(h), int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)), len(s), *band_keys(s)))
        return pd.DataFrame(rows, columns=["fp", "node", "n", "keys", "sketch"])

    rows = docs.select("doc_id", row_hash(docs).alias("row_hash"), F.xxhash64("text").alias("text_hash"), run("text").alias("s")).select("doc_id", "row_hash", "text_hash", "s.*")
    rows = common.materialise(rows, "fingerprints")
    # texts of one set in other orders have fingerprints of their own or not: the least stands for all
    nodes = rows.groupBy("node").agg(F.min(F.struct("text_hash", "fp", "n", "sketch")).alias("s"), F.first("keys").alias("keys")).select("node", "s.*", "keys")
    return rows.select("doc_id", "row_hash", "node"), common.materialise(nodes, "nodes")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")])


def of_texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, run) -> DataFrame:
    """node, s: a function of the text of each wanted node; texts are read for these only, of equal texts one."""
    wanted = common.materialise(wanted.join(nodes.select("node", "text_hash"), "node"), "wanted")
    common.text_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    texts = common.join_small(texts, wanted, ["text_hash"], "inner", wanted.count()).dropDuplicates(["node"])
    return common.materialise(texts.select("node", run("text").alias("s")), "sets")


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) of nodes whose shingle sets are similar enough; texts are read for these only.

    Where one node is in many pairs its set is copied, once for ``PAIRS_EACH`` of them, so they are spread over tasks.
    """
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(x, shingle)).view(np.int64) if x else np.empty(0, np.int64) for x in texts])

    if not pairs.count():
        return pairs
    sets = of_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, run)

    def attach(pairs: DataFrame, side: str) -> DataFrame:
        hot = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > PAIRS_EACH).select(side, F.ceil(F.col("m") / PAIRS_EACH).alias("copies"))
        hot = common.materialise(hot, "hot")
        few = common.small(hot, hot.count())
        copies = F.coalesce("copies", F.lit(1))
        left = pairs.join(few, side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), copies)).drop("copies")
        copied = sets.withColumnRenamed("node", side).withColumnRenamed("s", f"s{side}").join(few, side, "left")
        copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")
        return left.join(copied, [side, "salt"]).drop("salt")

    both = attach(attach(pairs, "b"), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def verified_links(nodes: DataFrame, docs: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """a, b: verified links of nodes that share a shard, enough of them to connect all that are connected within the radius.

    In a few rounds each text is compared with one other, the most alike of the
    texts that stand for its shards and aren't connected to it yet. What isn't
    connected to the first text of a shard after that is compared with the whole
    shard: first by sketches, which leaves the texts that meet one they may be
    similar to, then these by their whole sets, in the first shard of each pair.
    A shard hands on rows and a forest of links, never pairs, so what is written
    grows with its texts; all pairs are compared but those that are connected anyway.
    """
    # dealt out once: the count of each key and the join with it need no shuffle of their own
    shards = nodes.select("node", "fp", "n", "sketch", F.explode("keys").alias("key")).repartition("key")
    crowds = shards.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = common.materialise(shards.join(crowds, "key").withColumn("group", F.col("node")), "shards")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("rep.fp"))) <= radius
    sized = F.least("n", "rep.n") >= similarity * F.greatest("n", "rep.n")
    every = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for k in range(ROUNDS):
        rep = F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "fp", "n", "sketch", "group"))
        reps = members.groupBy("key").agg(rep.alias("rep"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high")
        pairs = members.join(reps, "key").filter(F.col("group") != F.col("rep.group")).filter(near & sized)
        pairs = pairs.select(F.col("node").alias("a"), F.col("rep.node").alias("b"), agreement("sketch", "rep.sketch").alias("same")).filter(F.col("same") >= AGREE)
        pairs = common.materialise(pairs.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b")), "pairs")
        found = common.materialise(alike(pairs, nodes, docs, shingle, similarity), "links")
        if not found.count():
            continue
        every = every.unionByName(found)
        members = members.drop("group").join(star_roots(every), "node", "left")
        members = common.materialise(members.select("key", "node", "fp", "n", "sketch", "m", F.coalesce("root", "node").alias("group")), "shards")
    lead = members.groupBy("key").agg(F.min_by("group", "node").alias("lead"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("key", "lead")
    rest = common.materialise(members.join(lead, "key").withColumn("out", F.col("group") != F.col("lead")).drop("sketch"), "rest")

    @F.pandas_udf("sketch binary, bands binary")
    def wide(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            least = least_of(np.unique(shingle_hashes(x, shingle)), WIDE)
            rows.append((sketch(least), keys_of(least[: BANDS * BAND]).tobytes()))
        return pd.DataFrame(rows, columns=["sketch", "bands"])

    rest = rest.join(of_texts(rest.select("node").distinct(), nodes, docs, wide).select("node", "s.*"), "node")
    outs = rest.groupBy("key").agg(
        F.sum(F.col("out").cast("long")).alias("outs"), F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("out_size"), F.sum("n").alias("size")
    )
    rest = rest.join(outs, "key")
    # what isn't connected to the first text is dealt out to blocks, each of which meets the whole shard in parts
    blocks = F.ceil(F.greatest(F.col("outs") / CELL, F.col("out_size") / SET_SIZES))
    parts = F.ceil(F.greatest(F.col("m") / CELL, F.col("size") / SET_SIZES))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    own, part = F.pmod(F.xxhash64("node"), blocks), F.pmod(F.xxhash64("node", F.lit(1)), parts)
    place = lambda block, part, home: F.struct(block.alias("block"), part.alias("part"), F.lit(home).alias("home"))
    home = F.when(F.col("out"), F.transform(upto(parts), lambda k: place(own, k, True))).otherwise(F.array().cast("array<struct<block:long,part:long,home:boolean>>"))
    guest = F.transform(F.filter(upto(blocks), lambda k: ~F.col("out") | (k != own)), lambda k: place(k, part, False))
    columns = ["node", "fp", "n", "sketch", "bands", "group"]
    dealt = rest.select("key", *columns, F.explode(F.concat(home, guest)).alias("p")).select("key", "p.*", *columns)

    def candidates(key: int, b: pd.DataFrame):
        """Places (i, j) and shared least hashes of pairs of different groups to verify in this shard: the first they share."""
        x, group, n = b["fp"].to_numpy(np.int64).view(np.uint64), b["group"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
        same, bands = sketches(b["sketch"]), sketches(b["bands"]).view(np.int64)
        for i, j in close_pairs(x, b["home"].to_numpy(bool), radius):
            use = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            i, j = i[use], j[use]
            for k in range(0, len(i), OTHERS):
                p, q = i[k : k + OTHERS], j[k : k + OTHERS]
                shared = bands[p] == bands[q]
                use = bands[p, shared.argmax(1)] == key
                p, q = p[use], q[use]
                count = (same[p] == same[q]).sum(1)
                use = count >= WIDE_AGREE
                yield p[use], q[use], count[use]

    def meeting(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """The rows that are in a pair to verify."""
        used = np.zeros(len(b), bool)
        for i, j, _ in candidates(key[0], b):
            used[i] = used[j] = True
        return b[used]

    def search(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """Verified links, no more than it takes to connect the rows: pairs that are connected by then aren't verified."""
        b = b.sort_values("node", kind="stable").reset_index(drop=True)
        node, sets, forest, out = b["node"].to_numpy(np.int64), list(b["s"]), Forest(len(b)), []
        of_group = b.groupby("group").cumcount(), b.groupby("group")["node"].transform("idxmin")
        forest.union(np.flatnonzero(of_group[0] > 0), of_group[1].to_numpy()[of_group[0] > 0])

        def verify(i: int, others: np.ndarray) -> None:
            one = sets[i]
            ends = np.cumsum([len(sets[j]) for j in others])
            joined = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
            hits = np.concatenate([[0], np.cumsum(one[at] == joined)])
            sizes = np.diff(ends, prepend=0)
            shared = hits[ends] - hits[ends - sizes]
            linked = others[shared >= similarity * (len(one) + sizes - shared)]
            if len(linked):
                linked = linked[np.unique(forest.roots(linked), return_index=True)[1]]
                out.extend((node[i], node[j]) for j in linked)
                forest.union(np.full(len(linked), i), linked)

        for i, j, count in candidates(key[0], b):
            order = np.lexsort((-count, i))
            i, j = i[order], j[order]
            firsts = np.flatnonzero(np.diff(i, prepend=-1))
            for at, others in zip(i[firsts], np.split(j, firsts[1:])):
                for only_best in (True, False):  # the most alike of each component, then what that didn't connect
                    roots = forest.roots(others)
                    open_ = roots != forest.roots(np.array([at]))[0]
                    others, roots = others[open_], roots[open_]
                    best = np.unique(roots, return_index=True)[1] if only_best else np.arange(len(others))
                    for k in range(0, len(best), VERIFIED_AT_ONCE):
                        verify(at, others[best[k : k + VERIFIED_AT_ONCE]])
                    if only_best:
                        others = np.delete(others, best)
                    if not len(others):
                        break
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(x, shingle).view(np.int64)) for x in texts])

    schema = dealt.schema
    met = common.materialise(dealt.groupBy("key", "block", "part").applyInPandas(meeting, schema), "meeting")
    if not met.count():
        return every
    whole = met.join(of_texts(met.select("node").distinct(), nodes, docs, sets), "node").select(*schema.names, "s")
    return every.unionByName(common.materialise(whole.groupBy("key", "block", "part").applyInPandas(search, "a long, b long"), "links"))


def keep_one(docs: DataFrame, shingle: int = WORDS, radius: int = REACH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of verified near copies, all columns.

    It is the row of the least id (null ids come last), then of the least hash
    of all columns; of rows that are equal in every column one stays. Rows of one id
    with different texts are judged each by its own text.
    """
    rows, nodes = distinct_sets(docs, shingle)
    roots = star_roots(verified_links(nodes, docs, shingle, radius, similarity))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    sets = rows.groupBy("node").agg(F.min(first).alias("r"))
    kept = sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias("i"), F.col("r.row_hash").alias("h"))
    every = rows.groupBy(F.col("doc_id").alias("i"), F.col("row_hash").alias("h")).agg(F.count(F.lit(1)).alias("times"))
    marked = every.join(kept.withColumn("kept", F.lit(True)), every["i"].eqNullSafe(kept["i"]) & (every["h"] == kept["h"]), "left").select(every["i"], every["h"], "times", "kept")
    marked = common.materialise(marked.filter("kept is null or times > 1"), "marked")
    names = {c: common.free_name(docs, c) for c in ("row_hash", "marked_id", "marked_hash")}
    hashed = docs.withColumn(names["row_hash"], row_hash(docs))

    def matched(df: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        marks = marks.select(F.col("i").alias(names["marked_id"]), F.col("h").alias(names["marked_hash"]))
        on = F.col("doc_id").eqNullSafe(F.col(names["marked_id"])) & (F.col(names["row_hash"]) == F.col(names["marked_hash"]))
        return df.join(common.small(marks, marks.count()), on, how)

    out = matched(hashed, marked.filter("kept is null"), "left_anti")
    again = marked.filter("kept")
    if again.count():  # rows equal in all columns, of which one is kept
        one = matched(hashed, again, "left_semi").dropDuplicates([names["row_hash"], "doc_id"])
        out = matched(out, again, "left_anti").unionByName(one)
    return out.select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "documents"))
