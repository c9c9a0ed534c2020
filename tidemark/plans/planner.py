"""Decisions as computations: how many workers, which task to repeat; and tables of a job's calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the models: granule (of the model's formula), share of memory, workers.
GRANULE, MOST_SHARE, LEAST_SHARE, MOST_WORKERS, LEAST_WORKERS = 64, 0.4, 0.065, 1000, 3
#: Of the straggler rules.
PROGRESS_QUANTILE, SEEN_SHARE, THRESHOLD_SHARE, LEAST_THRESHOLD = 0.2, 0.2, 0.15, 10.0
MOST_REPEATED, MOST_REPEATED_SHARE, LEFT_SHARE, LEFT_TASKS = 10, 0.1, 0.2, 7


def worker_range(size: int, memory_mb: int) -> tuple[int, int]:
    low = max(int(size / (memory_mb * 2**20 * MOST_SHARE)), LEAST_WORKERS)
    return low, max(min(int(size / (memory_mb * 2**20 * LEAST_SHARE)), MOST_WORKERS), LEAST_WORKERS)


def shuffle_seconds(p: Column, size: float, read_bw: float, write_bw: float, read_ops: float, write_ops: float) -> Column:
    """Predicted seconds with p workers: in each of four steps the slower of bandwidth and requests.

    ``size`` is in bytes while a granule counts 64, as in the model this follows.
    """
    of_p, of_p2 = F.ceil(F.lit(size) / (GRANULE * p)), F.ceil(F.lit(size) / (GRANULE * p * p))
    return (
        F.greatest(F.lit(size) / (read_bw * p), of_p * p / read_ops)
        + F.greatest(F.lit(size) / (write_bw * p), of_p2 * p * p / write_ops)
        + F.greatest(F.lit(size) / (read_bw * p), of_p2 * p * p / read_ops)
        + F.greatest(F.lit(size) / (write_bw * p), of_p * p / write_ops)
    )


def worker_curve(spark: SparkSession, size: int, memory_mb: int, **rates: float) -> DataFrame:
    low, high = worker_range(size, memory_mb)
    p = F.col("workers")
    return spark.range(low, high + 1).select(F.col("id").alias("workers")).withColumn("seconds", shuffle_seconds(p.cast("double"), float(size), **rates))


def best_workers(curve: DataFrame) -> DataFrame:
    """The first worker count of least time."""
    return curve.agg(F.min_by("workers", F.struct("seconds", "workers")).alias("workers"), F.min("seconds").alias("seconds"))


def throughput(probes: DataFrame) -> DataFrame:
    """workers, total of the sums of rates for each worker count; the best of them is the store's rate."""
    return probes.groupBy("workers").agg(F.sum("rate").alias("total"))


def probe_storage(spark: SparkSession, path: str, workers: list[int], mb: int = 4) -> DataFrame:
    """workers, read_bw, write_bw, read_ops, write_ops: bytes and files a second of so many tasks together, from files written to and read from ``path``.

    The path is left empty. The table is what ``worker_curve`` takes its rates from; keep it with ``write``.
    """
    import time

    from tidemark import shared
    from tidemark.sources import randombytes

    rows = []
    for n in workers:
        at, size = f"{path}/probe-{n}", n * mb << 20
        took = []
        for job in (
            lambda: randombytes.blocks(spark, size).repartition(n).write.mode("overwrite").option("compression", "none").parquet(at),  # noqa: B023
            lambda: spark.read.parquet(at).select(F.sum(F.octet_length("data"))).collect(),  # noqa: B023
        ):
            start = time.time()
            job()
            took.append(max(time.time() - start, 1e-6))
        shared.delete(spark, at)
        rows.append((n, size / took[1], size / took[0], n / took[1], n / took[0]))
    return spark.createDataFrame(rows, "workers int, read_bw double, write_bw double, read_ops double, write_ops double")


def remaining(progress: Column, elapsed: Column) -> Column:
    """Seconds left at the speed so far; 0 when finished, null when nothing is done."""
    return F.when(progress >= 1, F.lit(0.0)).when(progress > 0, (1 - progress) / (progress / elapsed))


def threshold(newest: Column) -> Column:
    return F.greatest(THRESHOLD_SHARE * newest, F.lit(LEAST_THRESHOLD))


def pick_straggler(tasks: DataFrame, total: int | None = None) -> DataFrame:
    """tasks: task, progress, elapsed, repeated boolean. The task to repeat, if any: the longest left of those in the lowest fifth of progress, after a while, neither finished nor repeated.

    A task that has done nothing is infinitely long left. With ``total``, the number of tasks of the job, none is picked before enough of them have reported.
    """
    if total is not None:
        seen = tasks.agg(F.count(F.lit(1)).alias("seen"))
        tasks = tasks.join(F.broadcast(seen.filter(may_repeat(F.col("seen"), F.lit(total))))).drop("seen")
    # one row for each task of a job
    stats = tasks.agg(F.percentile("progress", F.lit(PROGRESS_QUANTILE)).alias("q"), F.max("elapsed").alias("newest"))
    p, e = F.col("progress"), F.col("elapsed")
    rows = tasks.join(F.broadcast(stats)).withColumn("left", F.when(p == 0, F.lit(float("inf"))).otherwise((1 - p) / (p / e)))
    slow = rows.filter((F.col("progress") < F.col("q")) & (F.col("progress") < 1) & ~F.col("repeated") & (F.col("elapsed") >= threshold(F.col("newest"))))
    return slow.agg(F.max_by("task", F.struct("left", "task")).alias("task"), F.max("left").alias("left")).filter("task is not null")


def may_repeat(seen: Column, total: Column) -> Column:
    return seen > SEEN_SHARE * total


def stop_rule(repeated: Column, total: Column, finished: Column) -> Column:
    """Why no more tasks are repeated, or ``go on``."""
    left = total - finished
    return (
        F.when(repeated > MOST_REPEATED, "too many repeated")
        .when(repeated >= MOST_REPEATED_SHARE * total, "share repeated")
        .when(left <= 0, "all finished")
        .when(left < LEFT_SHARE * total, "few left")
        .when(left < LEFT_TASKS, "under seven left")
        .otherwise("go on")
    )


def active_histogram(calls: DataFrame, start: Column, end: Column, bins: int = 600, top: float = 600.0) -> DataFrame:
    """bin, n: how many calls cover each of ``bins`` points from 0 to ``top``; ends of calls don't count.

    Each call adds one at its first point and takes one off after its last:
    two rows a call, whatever it covers, and running sums over the bins.
    """
    from pyspark.sql import Window

    step = top / (bins - 1)
    first, last = F.greatest(F.ceil(start / step), F.lit(0)), F.least(F.ceil(end / step), F.lit(bins))
    moves = calls.select(first.alias("a"), last.alias("b")).filter("a < b")
    moves = moves.select(F.explode(F.array(F.struct(F.col("a").alias("bin"), F.lit(1).alias("d")), F.struct(F.col("b").alias("bin"), F.lit(-1).alias("d")))).alias("m")).groupBy("m.bin").agg(F.sum("m.d").alias("d"))
    grid = calls.sparkSession.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(moves), "bin", "left")
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row for each bin
    return grid.select("bin", F.coalesce(F.sum("d").over(w), F.lit(0)).cast("long").alias("n"))


def timeline(status: DataFrame, meta: DataFrame, job_start: Column, on: str = "call_id", times: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Status joined with metadata, and each time as seconds since the job's start."""
    out = status.join(meta, on)
    return out.select("*", *[(F.col(t) - job_start).alias(f"{t}_offset") for t in times])


def running_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, population variance and the 95 % interval of the mean."""
    out = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    half = 1.96 * F.sqrt("variance") / F.sqrt("n")
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)
