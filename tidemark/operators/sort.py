"""Global sort into key segments: one shuffle by segment, a sort in each, sorted files for each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import shared
from tidemark.operators import ranges
from tidemark.sources import delimited

SEGMENT = "segment"
GRANULE_MB = 64
MOST_REDUCERS = 1200


@dataclass(frozen=True)
class SortSpec:
    """key: column name. Either bounds or a number of segments, whose bounds then come from exact or sampled quantiles. ties: further columns of the order."""

    key: str
    segments: int | None = None
    bounds: list | None = None
    ties: tuple[str, ...] = ()
    sampled: bool = True
    rule: str = "left"  # or right, or drop


def bounds_of(df: DataFrame, spec: SortSpec) -> list:
    if spec.bounds is not None:
        n = spec.segments and spec.segments + (spec.rule == "drop")
        return ranges.check_bounds(spec.bounds, n)
    if not spec.segments or spec.segments < 1:
        raise ValueError("bounds or a number of segments are needed")
    inner = ranges.approximate(df, spec.key, spec.segments) if spec.sampled else ranges.quantiles(df, spec.key, spec.segments)
    return [None, *inner]


def with_segment(df: DataFrame, spec: SortSpec, bounds: list) -> DataFrame:
    rule = {"left": ranges.segment, "right": ranges.segment_right_closed, "drop": ranges.segment_dropping}[spec.rule]
    out = df.withColumn(SEGMENT, rule(F.col(spec.key), bounds))
    return out.filter(F.col(SEGMENT).isNotNull()) if spec.rule == "drop" else out


def order(spec: SortSpec) -> list[Column]:
    """Ascending, NaN after all numbers, null last."""
    return [F.col(c).asc_nulls_last() for c in (spec.key, *spec.ties)]


def sort_segments(df: DataFrame, spec: SortSpec) -> DataFrame:
    """The rows with their segment; partition i is segment i, sorted. Read in order of partitions it is the global sort."""
    if spec.key not in df.columns:
        raise ValueError(f"no column {spec.key!r}")
    bounds = bounds_of(df, spec)
    n = max(1, len(bounds) - (spec.rule == "drop"))
    # the segment leads the order, so that a write in folders of segments keeps the sort instead of doing one of its own
    return with_segment(df, spec, bounds).repartitionById(n, F.col(SEGMENT)).sortWithinPartitions(F.col(SEGMENT), *order(spec))


def with_position(df: DataFrame, spec: SortSpec, name: str = "position") -> DataFrame:
    """The rows with their place (from 1) in the global sort, and their segment.

    Rows are dealt by ranges of the whole order (segment, key, ties), so a key
    that most rows share is spread over tasks by its ties; the dealt and sorted
    rows are written once with their place in their partition, which the counts
    of the partitions before move up. One shuffle, no task for a key or segment.
    Rows equal in all of the order are numbered in any order. Without bounds
    the partitions are the segments.
    """
    if spec.key not in df.columns:
        raise ValueError(f"no column {spec.key!r}")
    spark = df.sparkSession
    lead = []
    rows = df
    if spec.bounds is not None:
        rows, lead = with_segment(df, spec, bounds_of(df, spec)), [F.col(SEGMENT)]
    elif not spec.segments or spec.segments < 1:
        raise ValueError("bounds or a number of segments are needed")
    by = [*lead, *order(spec)]
    n = max(spec.segments or 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())
    dealt = shared.materialise(dealt, "sorted")
    part = F.shiftright(F.col(name), 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = dealt.withColumn("part", part).join(shared.small(starts, n), "part")
    place = F.col("start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    segment = F.col(SEGMENT) if lead else F.col("part").cast("int").alias(SEGMENT)
    return out.select(*[F.col(c) for c in df.columns if c != name], segment, place.alias(name))


def write_segments(sorted_rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Sorted files in a folder of its own for each segment that has rows, one for each. sorted_rows: of ``sort_segments``."""
    sorted_rows.write.partitionBy(SEGMENT).format(fmt).save(path)


def read_segments(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    """The written rows with their segment, file and place in it: the order that the files hold."""
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(path)
    file = F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0)
    return rows.select("*", file.alias("file"), F.col("_metadata.row_index").alias("place")) if fmt == "parquet" else rows


def sort(spark: SparkSession, path: str, key: int | None = None, dtypes: list[str] | None = None, segments: int | None = None, bounds: list | None = None, delimiter: str | None = None, output: str | None = None, fmt: str = "csv", **options) -> DataFrame:
    """Sort a dataset; writes it too if ``output`` is given.

    ``csv``: delimited files by the column number ``key``. ``imzml``: the peaks
    of spectra by m/z; ``options`` are those of ``imzml.read``.
    """
    if fmt == "imzml":
        from tidemark.operators import imaging
        from tidemark.sources import imzml

        out = imaging.sort_by_mz(imzml.read(spark, path, **options), segments, bounds)
    elif fmt == "csv":
        if key is None or not dtypes or not 0 <= key < len(dtypes):
            raise ValueError("a key column is needed")
        out = sort_segments(delimited.read(spark, path, dtypes, delimiter), SortSpec(str(key), segments, bounds))
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if output:
        write_segments(out, output)
    return out


def is_sorted(df: DataFrame, key: str, by: Column, group: str | None = None) -> DataFrame:
    """Whether the key never falls along ``by``, for each group."""
    w = Window.partitionBy(group).orderBy(by) if group else Window.orderBy(by)
    step = df.withColumn("was", F.lag(key).over(w))
    return step.groupBy(*[group] if group else []).agg(F.bool_and(F.coalesce(F.col(key) >= F.col("was"), F.lit(True))).alias("is_sorted"))


def granule_manifest(df: DataFrame, group: str, bytes_per_row: int, granule_mb: float = GRANULE_MB) -> DataFrame:
    """Rows and granules of each segment; an empty slice still counts one."""
    each = max(1, int(granule_mb * 2**20) // bytes_per_row)
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("granules", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / each)).cast("long"))


def reducer_of(seg: Column, n: int, most: int = MOST_REDUCERS) -> Column:
    return F.pmod(seg, F.lit(min(n, most)))
