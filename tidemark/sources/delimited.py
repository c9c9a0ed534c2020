"""Header-less delimited files with a schema given as type names."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of numeric arrays and the Spark type that holds all their values.
TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "str": T.StringType(), "object": T.StringType(), "bytes": T.BinaryType(),
}
DELIMITERS = ";,:"
#: Rows looked at to find the delimiter and the mean row length.
HEAD_ROWS = 1000


def type_of(name: str) -> T.DataType:
    name = name.strip()
    if name.startswith(("|S", "S")) and name.lstrip("|S").isdigit():
        return T.BinaryType()
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    return TYPES[name]


def schema_of(dtypes: list[str]) -> T.StructType:
    """Columns named by their place: "0", "1", …"""
    if not dtypes:
        raise ValueError("dtypes are needed: the files have no header")
    return T.StructType([T.StructField(str(i), type_of(t)) for i, t in enumerate(dtypes)])


def fill_value(dtype: str):
    """The greatest value of a type, which sorts after all others."""
    t = type_of(dtype)
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
    if type(t) in bits and not dtype.startswith("u"):
        return 2 ** bits[type(t)] - 1
    if dtype.startswith("uint"):
        return 2 ** int(dtype[4:]) - 1
    return float("inf") if dtype.startswith("float") else chr(0x10FFFF) if isinstance(t, T.StringType) else b"\xff"


def head(spark: SparkSession, paths: str | list[str], rows: int = HEAD_ROWS) -> list[str]:
    return [r["value"] for r in spark.read.text(paths).limit(rows).collect()]


def sniff(spark: SparkSession, paths: str | list[str]) -> str:
    """The delimiter, from the first rows."""
    lines = head(spark, paths, 20)
    if not lines:
        return ","
    try:
        return csv.Sniffer().sniff("\n".join(lines)[:500], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return max(DELIMITERS, key=lambda d: min(x.count(d) for x in lines))


def read(spark: SparkSession, paths: str | list[str], dtypes: list[str], delimiter: str | None = None) -> DataFrame:
    """All files as one table; cells that don't fit their type are null, ``nan`` is NaN."""
    schema = schema_of(dtypes)
    reader = spark.read.schema(schema).option("sep", delimiter or sniff(spark, paths)).option("header", False).option("nanValue", "nan").option("mode", "PERMISSIVE")
    return reader.csv(paths)


def size(spark: SparkSession, paths: str | list[str]) -> int:
    """Bytes of the files; their contents aren't read."""
    return spark.read.format("binaryFile").load(paths).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def row_estimate(spark: SparkSession, paths: str | list[str]) -> int:
    """Rows as bytes by the mean row length of the first rows."""
    lines = head(spark, paths)
    return round(size(spark, paths) / (sum(len(x.encode()) + 1 for x in lines) / len(lines))) if lines else 0
