"""Spectra in images: pixels, peaks, ion images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.operators.sort import SortSpec, sort_segments


def dims(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """nrows, ncols and the least coordinates."""
    d = df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    return d.select((F.col("y1") - F.col("y0") + 1).cast("long").alias("nrows"), (F.col("x1") - F.col("x0") + 1).cast("long").alias("ncols"), "x0", "y0")


def with_pixel(df: DataFrame, x: str = "x", y: str = "y", name: str = "pixel") -> DataFrame:
    """Number the pixels by rows, from the least coordinates on, rounded to 5 digits."""
    r = df.withColumn("_x", F.round(F.col(x), 5)).withColumn("_y", F.round(F.col(y), 5))
    d = dims(r, "_x", "_y")
    number = (F.col("_y") - F.col("y0")) * F.col("ncols") + F.col("_x") - F.col("x0")
    return r.join(F.broadcast(d)).withColumn(name, number.cast("int")).drop("_x", "_y", "x0", "y0", "nrows", "ncols")


def physical(df: DataFrame, size_x: float, size_y: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("physical_x", F.col(x) * size_x).withColumn("physical_y", F.col(y) * size_y)


def peaks(df: DataFrame, *keep: str, mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """A row for each peak: the kept columns, mz, intensity."""
    pairs = F.arrays_zip(F.col(mz).alias("mz"), F.col(intensity).alias("intensity"))
    return df.select(*keep, F.inline(pairs).alias("mz", "intensity"))


def sorted_spectrum(mz: Column, intensity: Column) -> Column:
    """The peaks of one spectrum by mz, as an array of structs."""
    return F.array_sort(F.arrays_zip(mz.alias("mz"), intensity.alias("intensity")))


def counts(df: DataFrame, mz: str = "mz") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_spectra"), F.sum(F.size(mz)).cast("long").alias("n_values"))


def ion_image(df: DataFrame, value: float, tolerance: float, z: int | None = None, reduce: str = "sum", compat_bisect: bool = False) -> DataFrame:
    """y, x, value of the whole grid: intensities within the tolerance, 0 where there are none.

    With ``compat_bisect`` a spectrum with no peak below the interval's upper
    end but perhaps its first gives its first peak.
    """
    spectra = df.filter(F.col("z") == z) if z is not None else df
    low, high = value - abs(tolerance), value + abs(tolerance)
    if compat_bisect:
        pairs = F.arrays_zip("mz", "intensity")
        hit = F.filter(pairs, lambda p: (p["mz"] >= low) & (p["mz"] <= high))
        first = F.when(F.size("mz") > 0, F.slice(pairs, 1, 1)).otherwise(hit)
        below = F.size(F.filter(F.col("mz"), lambda m: m <= high)) <= 1
        hits = spectra.select("y", "x", F.inline(F.when(below, first).otherwise(hit)).alias("mz", "intensity"))
    else:
        hits = peaks(spectra, "y", "x").filter(F.col("mz").between(low, high))
    how = {"sum": F.sum, "max": F.max, "mean": F.avg, "min": F.min}[reduce]
    image = hits.groupBy("y", "x").agg(how("intensity").alias("v"))
    d = dims(spectra)
    grid = d.select(F.explode(F.sequence(F.col("y0").cast("long"), F.col("y0") + F.col("nrows") - 1)).alias("y"), "x0", "ncols")
    grid = grid.select("y", F.explode(F.sequence(F.col("x0").cast("long"), F.col("x0") + F.col("ncols") - 1)).alias("x"))
    return grid.join(image, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("value"))


def to_csv(df: DataFrame, path: str) -> None:
    """Rows idx, mz, intensity without a header, in the order of spectra."""
    peaks(df, "idx").sortWithinPartitions("idx").write.option("header", False).csv(path)


def sample_spectra(df: DataFrame, groups: int = 8, share: float = 0.01, idx: str = "idx") -> DataFrame:
    """About ``share`` of the spectra of each of so many ranges of spectra (the column ``group``), by a hash of their number; one of each range at least."""
    rows = spectrum_groups(df, groups, idx)
    h = F.pmod(F.xxhash64(F.col(idx)), F.lit(1 << 40))
    first = rows.groupBy("group").agg(F.min(h).alias("least"))  # one row for each range
    return rows.withColumn("h", h).join(F.broadcast(first), "group").filter((F.col("h") < share * (1 << 40)) | (F.col("h") == F.col("least"))).drop("h", "least")


def sampled_bounds(df: DataFrame, segments: int, groups: int = 8, share: float = 0.01, how: str = "fold") -> list[float]:
    """Inner bounds of m/z: quantiles of each range's sampled spectra, made one by ``how``."""
    found = peaks(sample_spectra(df, groups, share), "group")
    merged = ranges.merge_bounds(ranges.sampler_quantiles(found, F.col("group"), "mz", segments), how)
    return sorted(r["bound"] for r in merged.filter("bound is not null").collect())


def sort_by_mz(df: DataFrame, segments: int | None = None, bounds: list | None = None, how: str | None = None) -> DataFrame:
    """All peaks as (pixel, mz, intensity), in segments of mz. Without bounds: quantiles of a sample of peaks (with ``how``, of spectra, merged so), 0 and 100000 around them; peaks outside are dropped."""
    rows = peaks(with_pixel(df), "pixel")
    if bounds is None:
        if not segments:
            raise ValueError("bounds or a number of segments are needed")
        found = sampled_bounds(df, segments, how=how) if how else ranges.approximate(rows, "mz", segments)
        bounds = [0.0, *[b for b in found if 0.0 < b < 100000.0], 100000.0]
    return sort_segments(rows, SortSpec("mz", bounds=bounds, rule="drop"))


def spectrum_groups(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """n ranges of spectra with equal counts (differing by one at most), numbered from 0."""
    total = df.count()
    small, extra = divmod(total, n) if n else (0, 0)
    edge = extra * (small + 1)
    group = F.when(F.col(idx) < edge, F.floor(F.col(idx) / (small + 1))).otherwise(extra + F.floor((F.col(idx) - edge) / max(1, small)))
    return df.withColumn("group", group.cast("int"))
