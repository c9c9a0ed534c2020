"""Bounds, rules at the bounds, and the sort, on the fixtures that go wrong easily."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import ranges, sort
from tidemark.operators.sort import SEGMENT, SortSpec

KEYS = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, float("nan"), None]


def segments_of(spark, rule, bounds, keys=KEYS):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k double").coalesce(1)
    return [r["s"] for r in df.select("i", rule(F.col("k"), bounds).alias("s")).orderBy("i").collect()]


def test_rules_at_the_bounds(spark):
    assert segments_of(spark, ranges.segment, [0.0, 1.0, 2.0]) == [0, 0, 0, 1, 1, 2, 2, 2, 2]
    assert segments_of(spark, ranges.segment_right_closed, [0.0, 1.0, 2.0]) == [2, 0, 0, 0, 1, 1, 2, 2, 2]
    assert segments_of(spark, ranges.segment_dropping, [0.0, 1.0, 2.0]) == [None, 0, 0, 1, 1, None, None, None, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-20, 20).map(float), min_size=1, max_size=9), st.lists(st.integers(-25, 25).map(float), min_size=1, max_size=40))
def test_left_closed_equals_binary_search(spark, bounds, keys):
    bounds = sorted(bounds)
    want = np.searchsorted(np.array(bounds[1:]), np.array(keys), side="right").tolist()
    assert segments_of(spark, ranges.segment, bounds, keys) == want


def test_bounds_are_checked(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    for spec in (SortSpec("k"), SortSpec("k", 0), SortSpec("k", 3, [0, 1]), SortSpec("k", bounds=[2, 1]), SortSpec("none", 2)):
        with pytest.raises(ValueError):
            sort.sort_segments(df, spec)


def test_quantiles(spark):
    x = np.random.default_rng(1).normal(size=999).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "k double")
    assert np.allclose(ranges.quantiles(df, "k", 8), np.quantile(x, np.arange(1, 8) / 8))
    words = ["", "b", "A", "é", "\U0001f600", "zz"] * 7 + ["b"] * 30
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "k string")
    ordered = sorted(words)
    assert ranges.quantiles(df, "k", 6) == [ordered[int(i / 6 * len(words))] for i in range(1, 6)]
    assert ranges.quantiles(df.limit(0), "k", 4) == []


def test_merged_bounds(spark):
    parts = spark.createDataFrame([(0, [1.0, 10.0]), (1, [3.0, 10.0]), (2, [7.0, 40.0])], "sampler int, bounds array<double>")
    got = {how: [r["bound"] for r in ranges.merge_bounds(parts, how).orderBy("place").collect()] for how in ("fold", "mean", "median")}
    assert got["fold"] == [4.5, 25.0] and got["median"] == [3.0, 10.0]
    assert np.allclose(got["mean"], [11 / 3, 20.0])
    words = spark.createDataFrame([(0, ["b", "x"]), (1, ["a", "z"]), (2, ["c", "y"])], "sampler int, bounds array<string>")
    got = {how: [r["bound"] for r in ranges.merge_bounds(words, how).orderBy("place").collect()] for how in ("middle", "mean", "median")}
    assert got == {"middle": ["a", "z"], "mean": ["b", "y"], "median": ["b", "y"]}
    keys = spark.createDataFrame([(s, float(v)) for s in (0, 1) for v in range(10 * s, 10 * s + 9)], "s int, k double")
    found = {r["sampler"]: r["bounds"] for r in ranges.sampler_quantiles(keys, F.col("s"), "k", 4).collect()}
    assert found == {s: np.quantile(np.arange(10 * s, 10 * s + 9), [0.25, 0.5, 0.75]).tolist() for s in (0, 1)}
    assert ranges.with_minimum(["b"], "string") == ["\0", "b"] and ranges.with_minimum([1.0], "double") == [0.0, 1.0]
    with pytest.raises(ValueError):
        ranges.merge_bounds(parts, "other")


def partitions(df):
    return df.withColumn("p", F.spark_partition_id()).rdd.mapPartitions(lambda rows: [list(rows)]).collect()


@pytest.mark.parametrize("rule", ["left", "right"])
def test_partition_is_segment_and_sorted(spark, rule):
    rows = [(k, i) for i, k in enumerate(KEYS * 30)]
    out = partitions(sort.sort_segments(spark.createDataFrame(rows, "k double, i int"), SortSpec("k", bounds=[0.0, 1.0, 2.0], ties=("i",), rule=rule)))
    rank = lambda r: (r["k"] is None, r["k"] is not None and math.isnan(r["k"]), 0 if r["k"] is None or math.isnan(r["k"]) else r["k"], r["i"])
    assert len(out) == 3 and sum(map(len, out)) == len(rows)
    for p, part in enumerate(out):
        assert all(r[SEGMENT] == p for r in part) and [rank(r) for r in part] == sorted(rank(r) for r in part)


def test_one_key_on_most_rows(spark, tmp_path):
    rows = [(7.0, i) for i in range(900)] + [(float(i), 900 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "k double, i int")
    for spec in (SortSpec("k", 8, ties=("i",)), SortSpec("k", 8, ties=("i",), sampled=False)):
        got = sort.with_position(df, spec).orderBy("position").collect()
        assert [(r["k"], r["i"]) for r in got] == sorted(rows) and [r["position"] for r in got] == list(range(1, 1001))
    sort.write_segments(sort.sort_segments(df, SortSpec("k", bounds=[0.0, 7.0, 7.0, 500.0])), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 1000 and {r[0] for r in back.select(SEGMENT).distinct().collect()} == {0, 2}


def in_order(spark, path, key="k"):
    """The keys of each written file, as they lie in it."""
    rows = sort.read_segments(spark, path).orderBy("file", "place").collect()
    out = {}
    for r in rows:
        out.setdefault((r["file"], r[SEGMENT]), []).append(r[key])
    return list(out.values())


def test_written_files_are_sorted(spark, tmp_path):
    rank = lambda k: (k is None, k is not None and math.isnan(k), 0 if k is None or math.isnan(k) else k)
    rng = np.random.default_rng(2)
    keys = [*rng.normal(size=20_000).tolist(), *KEYS * 20]
    df = spark.createDataFrame([(float(k) if k is not None else None, i) for i, k in enumerate(keys)], "k double, i int").repartition(7)
    for rule, bounds in (("left", [-1.0, 0.0, 1.0]), ("right", [-1.0, 0.0, 1.0]), ("drop", [-2.0, 0.0, 2.0])):
        path = f"{tmp_path}/{rule}"
        sort.write_segments(sort.sort_segments(df, SortSpec("k", bounds=bounds, ties=("i",), rule=rule)), path)
        files = in_order(spark, path)
        assert len(files) == len(bounds) - (rule == "drop") and all(list(map(rank, f)) == sorted(map(rank, f)) for f in files)


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    out = sort.with_position(df, SortSpec("k", 8, ties=("i",)))
    sizes = [r["count"] for r in out.groupBy(SEGMENT).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 25_000
    got = out.select("k", "i", "position").collect()
    assert [r["position"] for r in sorted(got, key=lambda r: (r["k"], r["i"]))] == list(range(1, 100_001))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, tmp_path, n):
    df = spark.createDataFrame([(float(i), "x") for i in range(n)], "k double, v string")
    for spec in (SortSpec("k", 4), SortSpec("k", 4, sampled=False), SortSpec("k", bounds=[0.0, 1.0])):
        assert sort.sort_segments(df, spec).count() == n
        assert sorted(r["position"] for r in sort.with_position(df, spec).collect()) == list(range(1, n + 1))
    sort.write_segments(sort.sort_segments(df, SortSpec("k", bounds=[0.0, 1.0])), f"{tmp_path}/out")


def test_sortedness(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.5)], "i int, k double")
    assert sort.is_sorted(df.filter("i < 3"), "k", F.col("i")).first()[0] is True
    assert sort.is_sorted(df, "k", F.col("i")).first()[0] is False


def test_stratified_sample(spark):
    df = spark.range(100_000)
    near = ranges.stratified_sample(df, 0.01, place="id").withColumn("want", F.expr("id div 12500"))
    assert near.filter("stratum <> want").count() == 0 and 800 < near.count() < 1200
    n = ranges.stratified_sample(df, 0.01).groupBy("stratum").count().collect()
    assert len(n) == 8 and 800 < sum(r["count"] for r in n) < 1200
    assert ranges.stratified_sample(df, 0.01, seed=3).count() == ranges.stratified_sample(df, 0.01, seed=3).count()
