import struct

import pytest

import __spark_entry__ as entry
from tests.compare import connection, difference
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF, catalog.QUERIES[name], catalog.SQL[name]) == ""


def test_every_query_has_sql(spark):
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert abs(catalog.QUERIES["pi_estimate"](spark, SF).first()[0] - 3.14159) < 0.01


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sorted_arrays_keep_the_sign_of_zero(spark, tmp_path):
    rows = [(0, [0.5, -1e-8, 0.25, 1e-8]), (1, [0.0078125, -0.0078125, 0.0, -3.0]), (2, [-0.0, -4e-7, float("inf"), -float("inf")]), (3, [0.0234375, -0.0234375, 1e8, float("nan")])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = lambda v: struct.pack(f"{len(v)}d", *v)
    got = {r["idx"]: bits(r["sorted_mz"]) for r in catalog.QUERIES["spectrum_sorted_arrays"](spark, str(tmp_path)).collect()}
    sql = catalog.SQL["spectrum_sorted_arrays"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {k: bits(v) for k, v in connection(SF).execute(sql).fetchall()}
