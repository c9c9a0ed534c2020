"""Cost model, straggler rules, histogram and statistics against plain Python."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.plans import catalog, planner

RATES = dict(read_bw=40e6, write_bw=30e6, read_ops=2000.0, write_ops=1500.0)


def seconds(p, d, read_bw, write_bw, read_ops, write_ops):
    a, b = math.ceil(d / (64 * p)) * p, math.ceil(d / (64 * p * p)) * p * p
    return max(d / (read_bw * p), a / read_ops) + max(d / (write_bw * p), b / write_ops) + max(d / (read_bw * p), b / read_ops) + max(d / (write_bw * p), a / write_ops)


def test_workers(spark):
    assert planner.worker_range(10 * 2**30, 2048) == (12, 76) and planner.worker_range(1, 2048) == (3, 3) and planner.worker_range(10**15, 512)[1] == 1000
    curve = planner.worker_curve(spark, 10 * 2**30, 2048, **RATES)
    got = {r["workers"]: r["seconds"] for r in curve.collect()}
    assert list(got) == list(range(12, 77)) and all(math.isclose(v, seconds(p, 10 * 2**30, **RATES), rel_tol=1e-12) for p, v in got.items())
    assert planner.best_workers(curve).first()["workers"] == min(got, key=lambda p: (got[p], p))


def test_stragglers(spark):
    rng = random.Random(4)
    tasks = [(i, rng.choice([0.0, 1.0, *(k / 14 for k in range(1, 14))]), rng.uniform(5, 200), rng.random() < 0.1) for i in range(20)]
    df = spark.createDataFrame(tasks, "task int, progress double, elapsed double, repeated boolean")
    q, newest = np.quantile([t[1] for t in tasks], 0.2), max(t[2] for t in tasks)
    left = {t: (1 - p) / (p / e) if p else -1.0 for t, p, e, r in tasks if p < q and p < 1 and not r and e >= max(0.15 * newest, 10)}
    got = planner.pick_straggler(df).collect()
    assert [r["task"] for r in got] == ([max(left, key=lambda t: (left[t], t))] if left else [])
    assert planner.pick_straggler(df.filter("progress = 1")).count() == 0 and planner.pick_straggler(df.limit(0)).count() == 0
    rules = spark.createDataFrame([(11, 200, 0), (2, 20, 0), (0, 20, 20), (0, 100, 85), (0, 20, 14), (0, 20, 5)], "a int, b int, c int").coalesce(1)
    assert [r[0] for r in rules.select(planner.stop_rule(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["too many repeated", "share repeated", "all finished", "few left", "under seven left", "go on"]
    assert spark.range(1).select(planner.may_repeat(F.lit(5), F.lit(20)), planner.may_repeat(F.lit(4), F.lit(20))).first()[:] == (True, False)


def test_tasks_that_have_done_nothing_are_picked_first(spark, tmp_path):
    df = spark.createDataFrame([(i, p, 50.0, False) for i, p in enumerate([0.01, 0.0, 0.0, 0.02, *[0.9] * 16])], "task int, progress double, elapsed double, repeated boolean")
    assert [tuple(r) for r in planner.pick_straggler(df).collect()] == [(2, math.inf)]
    assert [r["task"] for r in planner.pick_straggler(df.filter("progress > 0")).collect()] == [0]
    events = spark.createDataFrame([(i, v, 30, "click") for i, v in enumerate([4.0, 0.0, 0.0, 8.0, *[360.0] * 16])], "event_id long, value double, user_id long, event_type string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    sql = catalog.SQL["straggler_pick"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r) for r in catalog.QUERIES["straggler_pick"](spark, str(tmp_path)).collect()] == duckdb.sql(sql).fetchall() == [(2, math.inf)]


def test_active_calls(spark):
    rng = random.Random(1)
    calls = [(a := rng.uniform(-5, 620), a + rng.uniform(0, 50)) for _ in range(300)]
    df = spark.createDataFrame(calls, "s double, e double")
    got = [r["n"] for r in planner.active_histogram(df, F.col("s"), F.col("e")).orderBy("bin").collect()]
    at = np.linspace(0, 600, 600)
    assert got == [int(sum(s <= x < e for s, e in calls)) for x in at]
    assert planner.active_histogram(df.limit(0), F.col("s"), F.col("e")).agg(F.sum("n")).first()[0] == 0


def test_statistics_and_timeline(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    got = {r["g"]: r for r in planner.running_stats(df, "g", "v").collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["variance"]) == (2, 2.0, 1.0) and math.isclose(got["a"]["ci_high"], 2 + 1.96 / math.sqrt(2))
    status, meta = spark.createDataFrame([(1, 12.0, 15.0)], "call_id int, start double, end double"), spark.createDataFrame([(1, "m")], "call_id int, name string")
    assert planner.timeline(status, meta, F.lit(10.0)).first()["end_offset"] == 5.0
    assert planner.throughput(spark.createDataFrame([(10, 1.0), (10, 2.0), (20, 5.0)], "workers int, rate double")).orderBy("workers").collect()[0]["total"] == 3.0


def test_column_functions(spark):
    row = spark.range(1).select(scalars.words(F.lit("  a b\n\tB a ")).alias("w"), scalars.readable_size(F.lit(1536)).alias("k"), scalars.readable_size(F.lit(5)).alias("b"), scalars.from_base64(scalars.to_base64(F.lit("é"))).alias("t"), scalars.typed(F.lit("x"), "int").alias("n"), scalars.typed(F.lit("7"), "int").alias("i")).first()
    assert row[:] == (["a", "b", "B", "a"], "1.5KiB", "5.0B", "é", None, 7)
