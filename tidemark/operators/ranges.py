"""Segment bounds and the rules that deal keys out to segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_SHARE, STRATA = 0.01, 8


def fractions(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def check_bounds(bounds: list, n: int | None = None) -> list:
    """n bounds for n segments; the first is only a lower end."""
    if n is not None and len(bounds) != n:
        raise ValueError(f"{len(bounds)} bounds for {n} segments")
    if any(a > b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("bounds must ascend")
    return list(bounds)


def quantiles(df: DataFrame, key: str, n: int) -> list:
    """Exact inner bounds: interpolated for numbers, the element int(q * rows) for strings. Null keys don't count."""
    known = df.filter(F.col(key).isNotNull())
    if dict(df.dtypes)[key] in ("string", "binary"):
        return string_quantiles(known, key, n)
    total = known.count()
    at = [q * (total - 1) for q in fractions(n)]
    places = sorted({int(x) for x in at} | {min(int(x) + 1, total - 1) for x in at}) if total else []
    got = dict(zip(places, elements(known, key, places, total)))
    return [got[int(x)] + (got[min(int(x) + 1, total - 1)] - got[int(x)]) * (x - int(x)) for x in at] if total else []


def string_quantiles(df: DataFrame, key: str, n: int) -> list:
    """Elements int(q * rows) of the sorted keys."""
    total = df.count()
    return elements(df, key, [int(q * total) for q in fractions(n)], total) if total else []


def elements(df: DataFrame, key: str, places: list[int], total: int | None = None) -> list:
    """The keys at the places (from 0, ascending) of the sorted keys, none of them null.

    Bounds of a sample cut the keys into ranges, whose rows are counted; only
    keys of ranges that hold a place are ranked, as distinct keys with counts.
    Nothing holds all keys, and no task more than a range.
    """
    if not places:
        return []
    bounds = approximate(df, key, 64, total=total)
    rows = df.select(F.col(key).alias("k"), segment(F.col(key), [None, *bounds]).alias("seg"))
    sizes = {r["seg"]: r["n"] for r in rows.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for s in sorted(sizes):
        if any(at <= p < at + sizes[s] for p in places):
            starts.append((s, at))
        at += sizes[s]
    start = F.coalesce(*[F.when(F.col("seg") == s, F.lit(a)) for s, a in starts])
    counts = rows.filter(F.col("seg").isin([s for s, _ in starts])).groupBy("seg", "k").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("seg").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(w) + start)
    hit = reduce(lambda a, b: a | b, [(F.col("upto") > p) & (F.col("upto") - F.col("n") <= p) for p in places])
    found = ranked.filter(hit).select("k", "upto", "n").collect()
    return [next(r[0] for r in found if r["upto"] - r["n"] <= p < r["upto"]) for p in places]


def approximate(df: DataFrame, key: str, n: int, rows: int = 20_000, total: int | None = None) -> list:
    """Inner bounds from a bounded sample of the keys: a hash threshold set from the row count, so that tasks hand on their share only.

    The hash is of the whole row: equal keys are drawn as often as they occur.
    """
    known = df.filter(F.col(key).isNotNull())
    total = known.count() if total is None else total
    if total > rows:
        known = known.filter(F.pmod(F.xxhash64(*map(F.col, df.columns)), F.lit(1 << 40)) < int((1 << 40) * rows / total)).limit(2 * rows)
    got = sorted(r[0] for r in known.select(key).collect())
    return sorted({got[int(q * len(got))] for q in fractions(n)}) if got else []


def stratified_sample(df: DataFrame, share: float = SAMPLE_SHARE, strata: int = STRATA, seed: int = 0, place: str | None = None, draw: Column | None = None) -> DataFrame:
    """About ``share`` of the rows of each stratum: equal ranges of the values of ``place`` (whole numbers), or without it parts that a hash of the row deals out.

    A row is drawn where ``draw`` (in [0, 1), by default from a hash of the
    row and the seed) is under the share, so the same rows are drawn again.
    """
    cols = [F.col(c) for c in df.columns]
    if draw is None:
        draw = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)
    if place is None:
        rows = df.withColumn("stratum", F.pmod(F.xxhash64(*cols), F.lit(strata)))
    else:
        ends = df.agg(F.min(place).alias("low"), F.max(place).alias("high"))  # one row
        rows = df.join(F.broadcast(ends)).withColumn("stratum", F.expr(f"(`{place}` - low) * {int(strata)} div (high - low + 1)")).drop("low", "high")
    return rows.filter(draw < share)


def sampler_quantiles(df: DataFrame, sampler: Column, key: str, n: int) -> DataFrame:
    """sampler, bounds array: each sampler's inner bounds; interpolated for numbers, the element int(q * rows) for strings.

    Keys are ranked in a sort that spills, not in a buffer of all a sampler's keys.
    """
    words = dict(df.dtypes)[key] in ("string", "binary")
    own = Window.partitionBy("sampler")
    rows = df.select(sampler.alias("sampler"), F.col(key).alias("k")).filter("k is not null")
    rows = rows.select("*", (F.row_number().over(own.orderBy("k")) - 1).alias("r"), F.count(F.lit(1)).over(own).alias("m"))
    at = [F.floor(F.lit(q) * F.col("m")) if words else F.lit(q) * (F.col("m") - 1) for q in fractions(n)]
    used = reduce(lambda a, b: a | b, [(F.col("r") >= F.floor(x)) & (F.col("r") <= F.ceil(x)) for x in at], F.lit(False))
    few = rows.filter(used)
    weight = lambda x: F.greatest(F.lit(0.0), 1 - F.abs(F.col("r") - x))
    one = lambda x: F.max(F.when(F.col("r") == x, F.col("k"))) if words else F.sum(F.when(weight(x) > 0, F.col("k") * weight(x)))
    return few.groupBy("sampler").agg(F.array(*[one(x) for x in at]).alias("bounds"))


def merge_bounds(parts: DataFrame, how: str = "mean") -> DataFrame:
    """place, bound: the samplers' bounds made one. how: mean, median, fold ((acc + x) / 2 in the samplers' order), or middle (the value of the middle sampler). Of strings, mean and median are the middle of the sorted values."""
    each = parts.select("sampler", F.posexplode("bounds").alias("place", "x")).withColumn("place", F.col("place").cast("long"))
    words = each.schema["x"].dataType.simpleString() in ("string", "binary")
    if words and how in ("mean", "median") or how == "middle":
        # strings have no mean: the middle of the samplers' values, sorted, or as the samplers come
        xs = F.array_sort(F.collect_list(F.struct("sampler", "x")))
        xs = F.transform(xs, lambda s: s["x"])
        listed = each.groupBy("place").agg((xs if how == "middle" else F.array_sort(xs)).alias("xs"))
        return listed.select("place", F.element_at("xs", F.floor(F.size("xs") / 2).cast("int") + 1).alias("bound"))
    if how == "mean":
        return each.groupBy("place").agg(F.avg("x").alias("bound"))
    if how == "median":
        # one value of each sampler: as many as there are samplers
        return each.groupBy("place").agg(F.percentile("x", F.lit(0.5)).alias("bound"))
    if how != "fold":
        raise ValueError(how)
    # one value of each sampler: as many as there are samplers
    xs = F.transform(F.array_sort(F.collect_list(F.struct("sampler", "x"))), lambda s: s["x"])
    listed = each.groupBy("place").agg(xs.alias("xs"))
    return listed.select("place", F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.col("xs")[0], lambda a, b: (a + b) / 2).alias("bound"))


def with_minimum(bounds: list, kind: str) -> list:
    """The bounds with the least value of their type before them."""
    return [{"string": "\0", "binary": b"\0"}.get(kind, 0.0), *bounds]


def tree(key: Column, bounds: list, first: int, test) -> Column:
    """The number of the bounds that ``test`` finds at or below the key, by halving: log(n) comparisons inside generated code."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(test(key, bounds[m]), tree(key, bounds[m + 1 :], first + m + 1, test)).otherwise(tree(key, bounds[:m], first, test))


def segment(key: Column, bounds: list) -> Column:
    """Segment i holds b_i <= key < b_i+1; the first bound is ignored, NaN and null go last."""
    last = len(bounds) - 1
    seg = tree(key, list(bounds[1:]), 0, lambda k, b: k >= F.lit(b))
    return F.when(key.isNull(), F.lit(last)).otherwise(seg).cast("int")


def segment_right_closed(key: Column, bounds: list) -> Column:
    """Segment i holds b_i < key <= b_i+1 and the first its lowest end; all else goes to the last segment (n bounds, n segments)."""
    last = len(bounds) - 1
    seg = tree(key, list(bounds[1:]), 0, lambda k, b: k > F.lit(b))
    outside = key.isNull() | (key < F.lit(bounds[0])) | (key > F.lit(bounds[-1]))
    return F.when(outside, F.lit(last)).otherwise(seg).cast("int")


def segment_dropping(key: Column, bounds: list) -> Column:
    """With n + 1 bounds: segment i holds b_i <= key < b_i+1, null for keys outside all."""
    inside = (key >= F.lit(bounds[0])) & (key < F.lit(bounds[-1]))
    return F.when(inside, tree(key, list(bounds[1:-1]), 0, lambda k, b: k >= F.lit(b))).cast("int")
