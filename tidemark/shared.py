"""Tables and files in the storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of a table that may be broadcast; beyond either it is shuffled instead.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 100_000

_written: list[tuple[SparkSession, str]] = []
_base: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own in the storage that all executors share.

    It is below ``spark.checkpoint.dir``; where that is unset (tests, local
    mode) it is a temporary folder of this machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _base:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _base[app] = f"{root.rstrip('/')}/tidemark-{app}"
    return _base[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``release`` deletes it."""
    if not _written:
        atexit.register(release)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_prefix(spark: SparkSession, prefix: str) -> int:
    """Delete all files and folders whose path starts with the prefix; how many there were."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(prefix).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pattern = jvm.org.apache.hadoop.fs.Path(prefix + "*")
    found = [x.getPath() for x in files.globStatus(pattern) or []]
    return sum(bool(files.delete(p, True)) for p in found)


def release() -> None:
    """Delete every table written by ``materialise``; their DataFrames end with it."""
    while _written:
        spark, path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended: nothing is left to ask
            _written.clear()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to shared storage and read back: a cut in the lineage that lost executors don't undo."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, bytes_each: int = 64) -> DataFrame:
    """The table, to be broadcast while its rows and their bytes are within the bounds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * bytes_each <= BROADCAST_BYTES else df
