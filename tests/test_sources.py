"""Delimited files, spectra, generated rows, and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import imaging, sort
from tidemark.operators.sort import SEGMENT, SortSpec
from tidemark.sources import delimited, imzml, objects, teragen
from tidemark.streaming import arrivals


@pytest.mark.parametrize("mark", list(";,:"))
def test_delimiters_and_missing_cells(spark, tmp_path, mark):
    path = str(tmp_path / "t.csv")
    rows = [f"{i}{mark}{i / 2}{mark}{'' if i == 3 else i * 1.5}" for i in range(20)] + [f"x{mark}nan{mark}2"]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    assert delimited.sniff(spark, path) == mark
    got = {r["0"]: r for r in delimited.read(spark, path, ["int32", "float64", "float32"]).collect()}
    assert got[3]["2"] is None and got[4]["2"] == 6.0 and np.isnan(got[None]["1"]) and len(got) == 21
    assert delimited.size(spark, path) == (tmp_path / "t.csv").stat().st_size
    assert abs(delimited.row_estimate(spark, path) - 21) <= 1
    out = sort.sort(spark, path, 1, ["int32", "float64", "float32"], bounds=[0.0, 4.0], output=f"{tmp_path}/out")
    assert out.count() == 21 and {r[0] for r in spark.read.parquet(f"{tmp_path}/out").select(SEGMENT).distinct().collect()} == {0, 1}
    for bad in (dict(fmt="tsv"), dict(key=None), dict(key=3)):
        with pytest.raises(ValueError):
            sort.sort(spark, path, **({"key": 1, "dtypes": ["int32", "float64", "float32"], "segments": 2} | bad))


def test_types():
    assert [f.dataType.simpleString() for f in delimited.schema_of(["int32", "float64", "|S10", "uint64", "str"])] == ["int", "double", "binary", "decimal(20,0)", "string"]
    assert delimited.fill_value("int16") == 32767 and delimited.fill_value("uint8") == 255 and delimited.fill_value("float32") == float("inf")
    for bad in ([], ["int33"]):
        with pytest.raises(ValueError):
            delimited.schema_of(bad)


SPECTRA = [(1, 1, 1, [100.0, 200.0, 300.0], [1.0, 2.0, 3.0]), (2, 1, None, [100.1, 250.0, 400.0], [4.0, 5.0, 6.0]), (1, 2, 2, [99.9, 199.9, 500.0], [7.0, 8.0, 9.0]), (2, 2, 1, [], [])]


@pytest.fixture
def image(tmp_path):
    path = str(tmp_path / "i.imzML")
    imzml.write(path, SPECTRA)
    return path


def test_spectra_are_read(spark, image, tmp_path):
    df = imzml.read(spark, image, spectraPerPartition=2)
    rows = df.orderBy("idx").collect()
    assert [(r["x"], r["y"], r["z"], r["mz"], r["intensity"]) for r in rows] == [(x, y, z or 1, mz, it) for x, y, z, mz, it in SPECTRA]
    assert [r["idx"] for r in df.filter("idx >= 2 and z = 1").collect()] == [3] and df.filter("idx = 9").count() == 0
    assert df.count() == 4  # the filters didn't stay with the table
    assert [r["idx"] for r in imzml.read(spark, image, first=1, last=2).orderBy("idx").collect()] == [1, 2]
    assert imzml.read(spark, image, z=1).count() == 3 and imzml.read(spark, image, first=9).count() == 0
    assert {r["name"]: r["value"] for r in imzml.metadata(spark, image).collect()} == {"pixel size x": 50.0}
    assert imzml.browse(spark, image).filter("idx = 0").first()["params"] == ["mz", "in"]
    assert imzml.read(spark, "file://" + image).count() == imzml.read(spark, "file:" + image).count() == 4
    imaging.to_csv(df, f"{tmp_path}/csv")
    back = delimited.read(spark, f"{tmp_path}/csv", ["int32", "float64", "float64"])
    assert sorted(map(tuple, back.collect())) == sorted((i, m, v) for i, s in enumerate(SPECTRA) for m, v in zip(s[3], s[4]))


def test_spectra_without_arrays(spark, image, tmp_path):
    xml = open(image).read()
    parts = xml.split("<binaryDataArrayList>")
    parts[2] = parts[2].partition("</binaryDataArrayList>")[2]  # the second spectrum has none
    path = str(tmp_path / "j.imzML")
    open(path, "w").write(parts[0] + "<binaryDataArrayList>" + parts[1] + parts[2] + "<binaryDataArrayList>" + "<binaryDataArrayList>".join(parts[3:]))
    rows = imzml.read(spark, path, ibd=image.replace(".imzML", ".ibd")).orderBy("idx").collect()
    assert [(r["x"], r["y"], r["mz"]) for r in rows] == [(1, 1, SPECTRA[0][3]), (2, 1, []), (1, 2, SPECTRA[2][3]), (2, 2, [])]


def test_entry_sorts_spectra(spark, image, tmp_path):
    out = sort.sort(spark, image, segments=2, fmt="imzml", output=f"{tmp_path}/out")
    assert out.count() == 9
    files = {}
    for r in sort.read_segments(spark, f"{tmp_path}/out").orderBy("file", "place").collect():
        files.setdefault((r["file"], r[SEGMENT]), []).append(r["mz"])
    assert all(f == sorted(f) for f in files.values()) and sum(map(len, files.values())) == 9
    sampled = imaging.sort_by_mz(imzml.read(spark, image), 2, how="fold")
    assert sampled.count() == 9 and imaging.sample_spectra(imzml.read(spark, image), 2).select("group").distinct().count() == 2


def test_physical_coordinates(spark, image):
    r = imaging.physical(imzml.read(spark, image), 50.0, 20.0).orderBy("idx").collect()[2]
    assert (r["physical_x"], r["physical_y"]) == (50.0, 40.0)


def test_offsets_beyond_32_bits():
    big = [16, 2**31 - 8, 2**31 + 100, 2**32 - 4, 2**32 + 50, 2**32 + 2**31 + 9]
    wrapped = [struct.unpack("<i", struct.pack("<I", x % 2**32))[0] for x in big]
    assert imzml.unwrapped(wrapped) == big and imzml.unwrapped(big) == big


def test_ion_image(spark, image):
    df = imzml.read(spark, image)
    value = lambda **k: {(r["y"], r["x"]): r["value"] for r in imaging.ion_image(df, 100.0, 0.15, **k).collect()}
    assert value() == {(1, 1): 1.0, (1, 2): 4.0, (2, 1): 7.0, (2, 2): 0.0}
    assert value(z=1) == {(1, 1): 1.0, (1, 2): 4.0, (2, 1): 0.0, (2, 2): 0.0}
    wide = {(r["y"], r["x"]): r["value"] for r in imaging.ion_image(df, 250.0, -60.0, reduce="max").collect()}
    assert wide == {(1, 1): 3.0, (1, 2): 5.0, (2, 1): 8.0, (2, 2): 0.0}
    pixels = {r["idx"]: r["pixel"] for r in imaging.with_pixel(df).collect()}
    assert pixels == {0: 0, 1: 1, 2: 2, 3: 3}
    out = imaging.sort_by_mz(df, segments=3)
    assert out.count() == 9 and [c for c in out.columns if c != SEGMENT] == ["pixel", "mz", "intensity"]
    assert imaging.sort_by_mz(df, bounds=[0.0, 150.0, 450.0]).count() == 8
    groups = imaging.spectrum_groups(spark.range(10).withColumnRenamed("id", "idx"), 4).groupBy("group").count().orderBy("group").collect()
    assert [r["count"] for r in groups] == [3, 3, 2, 2]


def test_generated_rows(spark, tmp_path):
    teragen.write(spark, 500, f"{tmp_path}/t", partitions=3)
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert len(lines) == 500 and all(len(x) == 99 and x[10] == "\t" for x in lines) and sorted(x[11:21] for x in lines) == [f"{i:010d}" for i in range(500)]
    assert teragen.rows(spark, 50, 1).exceptAll(teragen.rows(spark, 50, 1)).count() == 0 and teragen.rows(spark, 50, 1).select("key").intersect(teragen.rows(spark, 50, 2).select("key")).count() == 0


def test_urls_and_chunks(spark):
    got = spark.createDataFrame([("cos://b/p/q/o.csv",), ("cos://b/p/q/",), ("cos://b",), ("cos://b/o",)], "u string").coalesce(1).select(objects.split_url(F.col("u")).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [("cos", "b", "p/q", "o.csv"), ("cos", "b", "p/q", ""), ("cos", "b", "", ""), ("cos", "b", "", "o")]
    for bad in (["cos://b/o", "swift://b/o"], ["cos://b/o", "cos://b"]):
        with pytest.raises(ValueError):
            objects.one_backend(bad)
    sizes = spark.createDataFrame([("a", 10), ("b", 3), ("c", 0)], "key string, size long")
    rows = [tuple(r) for r in objects.chunks(sizes, "key", "size", chunk_size=4).orderBy("key", "part").collect()]
    assert rows == [("a", k, 4 * k, 4 * k + 4 + objects.OVERLAP) for k in range(3)] + [("b", 0, 0, 3)]
    assert objects.fragment(10, 3) == [(0, 4), (4, 8), (8, 10)]


def test_rows_that_arrive(spark, tmp_path):
    spec = SortSpec("k", bounds=[0, 40, 70])
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for start in (0, 50):
        spark.range(start, start + 50).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arrivals.write_arriving(stream, spec, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    out = arrivals.compact(spark, f"{tmp_path}/out", spec)
    counts = {r[SEGMENT]: r["count"] for r in out.groupBy(SEGMENT).count().collect()}
    assert counts == {0: 40, 1: 30, 2: 30}
    for run in range(2):
        runs = {}
        for r in sort.read_segments(spark, f"{tmp_path}/out/batch={run}").orderBy("file", "place").collect():
            runs.setdefault((r["file"], r[SEGMENT]), []).append(r["k"])
        assert runs and all(k == sorted(k) for k in runs.values())
    with pytest.raises(ValueError):
        arrivals.write_arriving(stream, SortSpec("k", 3), f"{tmp_path}/o", f"{tmp_path}/s")
