"""Objects and how they are cut into byte ranges."""

from __future__ import annotations

import io
import os
import re
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a chunk reads beyond its end to finish its last line.
OVERLAP = 131_072
#: Bytes looked through at once for a line end.
LOOK = 65_536


def open_file(path: str):
    """Random access to a file of any storage that pyarrow knows by its URI; plain paths are local."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", path) and not path.startswith("file:"):
        files, name = pafs.FileSystem.from_uri(path)
        return files.open_input_file(name)
    return pafs.LocalFileSystem().open_input_file(os.path.abspath(re.sub(r"^file:(//)?(?=/)", "", path)))


def line_start(f, at: int, size: int) -> int:
    """The first start of a line at or after a place of a file, or its size."""
    at = min(at, size)
    if at == 0:
        return 0
    f.seek(at - 1)
    while block := f.read(LOOK):
        if (k := block.find(b"\n")) >= 0:
            return f.tell() - len(block) + k + 1
    return size


class Lines(io.RawIOBase):
    """A stream of the bytes from ``start`` to ``end`` of an open file."""

    def __init__(self, f, start: int, end: int):
        self.f, self.at, self.end = f, start, end
        f.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.f.read(min(len(buffer), self.end - self.at))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.f.close()
        super().close()


@dataclass(frozen=True)
class ObjectPart:
    """What a function of an ``obj`` gets: an object, or the part of it that it is to read."""

    path: str
    size: int
    part: int = 0
    start: int = 0
    chunk_size: int | None = None  # None: the whole object

    @property
    def bucket(self) -> str:
        return re.sub(r"^[^:/]*:/*", "", self.path).split("/")[0]

    @property
    def key(self) -> str:
        return re.sub(r"^[^:/]*:/*", "", self.path).partition("/")[2]

    @property
    def data_byte_range(self) -> tuple[int, int] | None:
        return self.chunk_size and (self.start, self.start + self.chunk_size + OVERLAP)

    @property
    def data_stream(self) -> io.BufferedReader:
        """A new stream of the lines that begin in the part, each whole however long: no line is in two parts."""
        f = open_file(self.path)
        whole = self.chunk_size is None
        start = 0 if whole else line_start(f, self.start, self.size)
        end = self.size if whole else line_start(f, self.start + self.chunk_size, self.size)
        return io.BufferedReader(Lines(f, start, max(start, end)))


def split_url(url: Column) -> Column:
    """backend, bucket, prefix, object of ``backend://bucket/prefix/object``; a trailing slash means that all is prefix."""
    rest = F.regexp_extract(url, r"^[^:]+://[^/]+/?(.*)$", 1)
    return F.struct(
        F.regexp_extract(url, r"^([^:]+)://", 1).alias("backend"),
        F.regexp_extract(url, r"^[^:]+://([^/]+)", 1).alias("bucket"),
        F.regexp_replace(rest, r"/?[^/]*$", "").alias("prefix"),
        F.regexp_extract(rest, r"([^/]*)$", 1).alias("object"),
    )


def one_backend(urls: list[str]) -> str:
    """The common backend; raises where backends or kinds (buckets, objects) are mixed."""
    backends = {u.split("://")[0] if "://" in u else "" for u in urls}
    kinds = {u.endswith("/") or "/" not in u.split("://")[-1] for u in urls}
    if len(backends) > 1:
        raise ValueError(f"objects of several backends: {sorted(backends)}")
    if len(kinds) > 1:
        raise ValueError("buckets or prefixes and single objects can't be mixed")
    return backends.pop()


def list_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size of the objects that aren't empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", F.col("length").alias("size")).filter("size > 0")


def cuts(objects: DataFrame, key: str, size: str, chunk_size: int | None = None, chunk_number: int | None = None) -> DataFrame:
    """key, size, chunk, cut, part, start of every chunk of objects that aren't empty.

    ``chunk_number`` gives chunks of size // number + size % number bytes; an
    object is only cut if it is larger than a chunk.
    """
    n = F.col(size).cast("long")
    if chunk_number:
        each = F.expr(f"`{size}` div {int(chunk_number)}") + n % chunk_number
    elif chunk_size:
        each = F.lit(int(chunk_size)).cast("long")
    else:
        each = n
    rows = objects.filter(n > 0).select(F.col(key), n.alias("size"), each.alias("chunk"))
    rows = rows.withColumn("cut", F.col("size") > F.col("chunk"))
    starts = F.when(F.col("cut"), F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("chunk"))).otherwise(F.array(F.lit(0).cast("long")))
    return rows.select(key, "size", "chunk", "cut", F.posexplode(starts).alias("part", "start")).withColumn("part", F.col("part").cast("long"))


def chunks(objects: DataFrame, key: str, size: str, chunk_size: int | None = None, chunk_number: int | None = None) -> DataFrame:
    """key, part, start, end (with the overlap) of every chunk that ``cuts`` makes."""
    rows = cuts(objects, key, size, chunk_size, chunk_number)
    return rows.select(key, "part", "start", F.when(F.col("cut"), F.col("start") + F.col("chunk") + OVERLAP).otherwise(F.col("size")).alias("end"))


def parts(spark: SparkSession, paths: str | list[str], chunk_size: int | None = None, chunk_number: int | None = None) -> DataFrame:
    """path, size, part, start, chunk_size (null for objects left whole): the fields of ``ObjectPart``."""
    rows = cuts(list_objects(spark, paths), "path", "size", chunk_size, chunk_number)
    return rows.select("path", "size", "part", "start", F.when(F.col("cut"), F.col("chunk")).alias("chunk_size"))


def fragment(total: int, n: int) -> list[tuple[int, int]]:
    """n ranges of ceil-like width total // n + 1 that cover 0 to total."""
    width = total // n + 1
    return [(min(i * width, total), min((i + 1) * width, total)) for i in range(n)]
