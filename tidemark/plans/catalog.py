"""Queries of the engine by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections import Counter
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import shared
from tidemark.functions import scalars
from tidemark.operators import imaging, mapreduce, ranges, sort
from tidemark.operators.sort import SortSpec
from tidemark.plans import planner
from tidemark.sources import delimited, objects, randombytes, teragen

QUERIES: dict = {}
SQL: dict[str, str] = {}

TIES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
TIES_SQL = ", ".join(TIES)
PRICES = [0.0, 10_000.0, 25_000.0, 40_000.0, 60_000.0]
SEGMENT_SQL = "CASE WHEN {k} >= 60000 THEN 4 WHEN {k} >= 40000 THEN 3 WHEN {k} >= 25000 THEN 2 WHEN {k} >= 10000 THEN 1 ELSE 0 END"


def query(sql: str | None = None, *tables: str):
    """Register a function of the named tables."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, *[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT {TIES_SQL}, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, {TIES_SQL}) AS position FROM lineitem", "lineitem")
def sort_global_numeric(spark, lineitem):
    rows = lineitem.select(*TIES, "l_extendedprice")
    return sort.with_position(rows, SortSpec("l_extendedprice", 32, ties=TIES)).drop(sort.SEGMENT)


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS position FROM orders", "orders")
def sort_global_string(spark, orders):
    rows = orders.select("o_orderkey", "o_orderpriority")
    return sort.with_position(rows, SortSpec("o_orderpriority", 8, ties=("o_orderkey",))).drop(sort.SEGMENT)


@query("SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS position FROM events", "events")
def sort_by_timestamp(spark, events):
    return sort.with_position(events.select("event_id", "ts"), SortSpec("ts", 16, ties=("event_id",))).drop(sort.SEGMENT)


@query(
    f"""SELECT segment, count(*) AS n_rows, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM (SELECT CAST({SEGMENT_SQL.format(k="l_extendedprice")} AS INTEGER) AS segment, l_extendedprice FROM lineitem) GROUP BY segment""",
    "lineitem",
)
def sort_segments_explicit(spark, lineitem):
    rows = sort.sort_segments(lineitem.select("l_extendedprice"), SortSpec("l_extendedprice", 5, PRICES))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query(
    f"""SELECT CAST({SEGMENT_SQL.format(k="l_extendedprice")} AS INTEGER) AS segment, {TIES_SQL}, l_extendedprice,
    row_number() OVER (PARTITION BY {SEGMENT_SQL.format(k="l_extendedprice")} ORDER BY l_extendedprice, {TIES_SQL}) AS place FROM lineitem""",
    "lineitem",
)
def sort_written_files(spark, lineitem):
    """The rows of sorted files as they lie in them."""
    path = shared.shared_path(spark, "segments")
    sort.write_segments(sort.sort_segments(lineitem.select(*TIES, "l_extendedprice"), SortSpec("l_extendedprice", 5, PRICES, TIES)), path)
    rows = sort.read_segments(spark, path)
    return rows.select("segment", *TIES, "l_extendedprice", (F.col("place") + 1).alias("place"))


@query(
    """SELECT segment, count(*) AS n_rows, min(l_quantity) AS low, max(l_quantity) AS high FROM (
    SELECT CAST(CASE WHEN l_quantity < 5 OR l_quantity > 40 THEN 3 WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS INTEGER) AS segment, l_quantity FROM lineitem) GROUP BY segment""",
    "lineitem",
)
def segments_cut_right_closed(spark, lineitem):
    rows = lineitem.select("l_quantity", ranges.segment_right_closed(F.col("l_quantity"), [5.0, 10.0, 25.0, 40.0]).alias("segment"))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


PEAKS_SQL = "SELECT vec_id, unnest(range(1, 65)) AS place, unnest(embedding) AS v FROM embeddings"


def spectra(embeddings: DataFrame) -> DataFrame:
    """Embeddings as spectra: 20 pixels a row, places as m/z, values as intensities."""
    return embeddings.select(
        F.col("vec_id").alias("idx"),
        (F.col("vec_id") % 20).cast("int").alias("x"),
        F.expr("vec_id div 20").cast("int").alias("y"),
        F.lit(1).alias("z"),
        F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda k: k.cast("double")).alias("mz"),
        F.transform("embedding", lambda v: v.cast("double")).alias("intensity"),
    )


@query(
    f"""SELECT segment, count(*) AS n_rows, min(v) AS low, max(v) AS high FROM (SELECT CAST(CASE WHEN v >= 0.1 THEN 3 WHEN v >= 0 THEN 2 WHEN v >= -0.1 THEN 1 ELSE 0 END AS INTEGER) AS segment, v
    FROM (SELECT CAST(v AS DOUBLE) AS v FROM ({PEAKS_SQL})) WHERE v >= -0.3 AND v < 0.3) GROUP BY segment""",
    "embeddings",
)
def segments_imzml_bounds(spark, embeddings):
    rows = imaging.peaks(spectra(embeddings)).withColumn("segment", ranges.segment_dropping(F.col("intensity"), [-0.3, -0.1, 0.0, 0.1, 0.3]))
    rows = rows.filter("segment is not null")
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.min("intensity").alias("low"), F.max("intensity").alias("high"))


@query(
    f"""SELECT segment, count(*) AS n_rows, min(mz) AS low, max(mz) AS high, CAST(sum(pixel) AS BIGINT) AS pixels, true AS in_order FROM (
    SELECT CAST(CASE WHEN place >= 40 THEN 2 WHEN place >= 20 THEN 1 ELSE 0 END AS INTEGER) AS segment, CAST(place AS DOUBLE) AS mz, vec_id AS pixel FROM ({PEAKS_SQL}) WHERE place >= 5 AND place < 60) GROUP BY segment""",
    "embeddings",
)
def sort_by_mz(spark, embeddings):
    """Peaks in written segments of m/z, and whether each file is in order."""
    path = shared.shared_path(spark, "peaks")
    sort.write_segments(imaging.sort_by_mz(spectra(embeddings), bounds=[5.0, 20.0, 40.0, 60.0]), path)
    rows = sort.read_segments(spark, path)
    was = F.lag("mz").over(Window.partitionBy("segment", "file").orderBy("place"))
    rows = rows.withColumn("ok", F.coalesce(F.col("mz") >= was, F.lit(True)))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.min("mz").alias("low"), F.max("mz").alias("high"), F.sum("pixel").alias("pixels"), F.bool_and("ok").alias("in_order"))


@query("SELECT CAST(i - 1 AS BIGINT) AS place, round(b, 6) AS bound FROM (SELECT unnest(range(1, 8)) AS i, unnest(quantile_cont(l_extendedprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS b FROM lineitem)", "lineitem")
def bounds_exact_quantiles(spark, lineitem):
    got = ranges.quantiles(lineitem.select("l_extendedprice"), "l_extendedprice", 8)
    return spark.createDataFrame(list(enumerate(got)), "place long, bound double").withColumn("bound", F.round("bound", 6))


@query(
    """SELECT CAST(k - 1 AS BIGINT) AS place, (SELECT p FROM (SELECT p_name AS p, row_number() OVER (ORDER BY p_name) - 1 AS r FROM part) WHERE r = CAST(floor(k / 8.0 * (SELECT count(*) FROM part)) AS BIGINT)) AS bound
    FROM (SELECT unnest(range(1, 8)) AS k)""",
    "part",
)
def bounds_string_quantiles(spark, part):
    got = ranges.string_quantiles(part.select("p_name"), "p_name", 8)
    return spark.createDataFrame(list(enumerate(got)), "place long, bound string")


SAMPLERS_SQL = "SELECT l_orderkey % 8 AS s, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS b FROM lineitem GROUP BY 1"


def sampled(lineitem: DataFrame) -> DataFrame:
    return ranges.sampler_quantiles(lineitem, F.col("l_orderkey") % 8, "l_extendedprice", 4)


@query(
    f"""SELECT CAST(k - 1 AS BIGINT) AS place, round(list_reduce(list(b[k] ORDER BY s), lambda a, x: (a + x) / 2), 4) AS bound
    FROM ({SAMPLERS_SQL}), (SELECT unnest(range(1, 4)) AS k) GROUP BY k""",
    "lineitem",
)
def bounds_sampled_fold(spark, lineitem):
    return ranges.merge_bounds(sampled(lineitem), "fold").select("place", F.round("bound", 4).alias("bound"))


@query(f"SELECT CAST(k - 1 AS BIGINT) AS place, round(avg(b[k]), 4) AS bound FROM ({SAMPLERS_SQL}), (SELECT unnest(range(1, 4)) AS k) GROUP BY k", "lineitem")
def bounds_merge_mean(spark, lineitem):
    return ranges.merge_bounds(sampled(lineitem), "mean").select("place", F.round("bound", 4).alias("bound"))


@query(f"SELECT CAST(k - 1 AS BIGINT) AS place, round(quantile_cont(b[k], 0.5), 4) AS bound FROM ({SAMPLERS_SQL}), (SELECT unnest(range(1, 4)) AS k) GROUP BY k", "lineitem")
def bounds_merge_median(spark, lineitem):
    return ranges.merge_bounds(sampled(lineitem), "median").select("place", F.round("bound", 4).alias("bound"))


WORD_SAMPLERS_SQL = "SELECT p_partkey % 5 AS s, list(p_name ORDER BY p_name) AS b, count(*) AS m FROM part GROUP BY 1"
WORD_BOUNDS_SQL = f"SELECT s, CAST(k - 1 AS BIGINT) AS place, b[CAST(floor(k / 4.0 * m) AS BIGINT) + 1] AS x FROM ({WORD_SAMPLERS_SQL}), (SELECT unnest(range(1, 4)) AS k)"


@query(f"SELECT place, list(x ORDER BY s)[3] AS bound, list(x ORDER BY x)[3] AS middle FROM ({WORD_BOUNDS_SQL}) GROUP BY place", "part")
def bounds_merge_string(spark, part):
    """String bounds of samplers made one: the middle sampler's, and the middle of all."""
    parts = ranges.sampler_quantiles(part, F.col("p_partkey") % 5, "p_name", 4)
    return ranges.merge_bounds(parts, "middle").join(ranges.merge_bounds(parts, "median").withColumnRenamed("bound", "middle"), "place")


@query("SELECT seg AS segment, count(*) AS n_rows FROM (SELECT CASE WHEN place >= 49 THEN 3 WHEN place >= 33 THEN 2 WHEN place >= 17 THEN 1 ELSE 0 END AS seg FROM (" + PEAKS_SQL + ")) GROUP BY seg", "embeddings")
def imzml_sampled_bounds(spark, embeddings):
    """Bounds from sampled spectra of each range, folded; every spectrum has the m/z 1 to 64 here, so the bounds are theirs."""
    rows = imaging.peaks(spectra(embeddings))
    bounds = imaging.sampled_bounds(spectra(embeddings), 4)
    return rows.groupBy(ranges.segment(F.col("mz"), [None, *bounds]).alias("segment")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    f"SELECT max(n) AS most, round(avg(n), 4) AS mean, round(max(n) / avg(n), 6) AS balance FROM (SELECT {SEGMENT_SQL.format(k='l_extendedprice')} AS s, count(*) AS n FROM lineitem GROUP BY 1)",
    "lineitem",
)
def segment_sizes_balance(spark, lineitem):
    sizes = lineitem.groupBy(ranges.segment(F.col("l_extendedprice"), PRICES).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.max("n") / F.avg("n"), 6).alias("balance"))


@query(
    f"SELECT segment, count(*) AS n_rows, greatest(1, CAST(ceil(count(*) / 1048.0) AS BIGINT)) AS granules FROM (SELECT CAST({SEGMENT_SQL.format(k='l_extendedprice')} AS INTEGER) AS segment FROM lineitem) GROUP BY segment",
    "lineitem",
)
def granule_manifest(spark, lineitem):
    rows = lineitem.select(ranges.segment(F.col("l_extendedprice"), PRICES).alias("segment"))
    return sort.granule_manifest(rows, "segment", 1000, 1.0)


@query("SELECT range AS segment, range % 1200 AS reducer FROM range(3000)")
def reducer_assignment(spark):
    return spark.range(3000).select(F.col("id").alias("segment"), sort.reducer_of(F.col("id"), 2000).cast("long").alias("reducer"))


@query(
    """SELECT l_returnflag, bool_and(coalesce(l_extendedprice >= was, true)) AS is_sorted FROM (
    SELECT l_returnflag, l_extendedprice, lag(l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS was FROM lineitem) GROUP BY 1""",
    "lineitem",
)
def is_sorted_check(spark, lineitem):
    by = F.struct(*TIES)
    return sort.is_sorted(lineitem, "l_extendedprice", by, "l_returnflag")


@query(
    """SELECT doc_id, CAST(k AS BIGINT) AS part, CAST(k * 1000 AS BIGINT) AS start, CASE WHEN n_chars > 1000 THEN k * 1000 + 1000 + 131072 ELSE n_chars END AS "end"
    FROM (SELECT doc_id, n_chars, unnest(range(0, CASE WHEN n_chars > 1000 THEN (n_chars - 1) // 1000 + 1 ELSE 1 END)) AS k FROM documents WHERE n_chars > 0)""",
    "documents",
)
def chunk_plan_size(spark, documents):
    return objects.chunks(documents, "doc_id", "n_chars", chunk_size=1000)


@query(
    """SELECT doc_id, CAST(k AS BIGINT) AS part, CAST(k * c AS BIGINT) AS start, CASE WHEN n_chars > c THEN k * c + c + 131072 ELSE n_chars END AS "end"
    FROM (SELECT doc_id, n_chars, c, unnest(range(0, CASE WHEN n_chars > c THEN (n_chars - 1) // c + 1 ELSE 1 END)) AS k
      FROM (SELECT doc_id, n_chars, n_chars // 3 + n_chars % 3 AS c FROM documents WHERE n_chars > 0))""",
    "documents",
)
def chunk_plan_number(spark, documents):
    return objects.chunks(documents, "doc_id", "n_chars", chunk_number=3)


@query(
    r"""SELECT page_id, regexp_extract(url, '^([^:]+)://', 1) AS backend, regexp_extract(url, '^[^:]+://([^/]+)', 1) AS bucket,
    regexp_replace(regexp_extract(url, '^[^:]+://[^/]+/?(.*)$', 1), '/?[^/]*$', '') AS prefix, regexp_extract(regexp_extract(url, '^[^:]+://[^/]+/?(.*)$', 1), '([^/]*)$', 1) AS object FROM pages""",
    "pages",
)
def url_split(spark, pages):
    return pages.select("page_id", objects.split_url(F.col("url")).alias("u")).select("page_id", "u.*")


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS estimate, CAST(100 * count(*) AS BIGINT) AS size FROM orders", "orders")
def row_estimate(spark, orders):
    """Rows of equal length, as many as orders: the estimate from the first rows is exact."""
    path, n = shared.shared_path(spark, "rows"), orders.count()
    teragen.write(spark, n, path)
    return spark.createDataFrame([(n, delimited.row_estimate(spark, path), delimited.size(spark, path))], "n_rows long, estimate long, size long")


def as_csv(df: DataFrame, mark: str) -> str:
    path = shared.shared_path(df.sparkSession, "csv")
    df.write.option("sep", mark).option("header", False).csv(path)
    return path


@query(
    """SELECT l_linenumber AS line, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(sum(CAST(l_quantity AS FLOAT)), 2) AS quantity, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1""",
    "lineitem",
)
def csv_scan(spark, lineitem):
    """A header-less delimited dataset, its delimiter found from the first rows."""
    path = as_csv(lineitem.select("l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"), ";")
    rows = delimited.read(spark, path, ["int32", "float64", "float32", "str"])
    return rows.groupBy(F.col("0").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("1"), 2).alias("price"), F.round(F.sum("2"), 2).alias("quantity"), F.count_distinct("3").alias("flags"))


@query("SELECT * FROM (VALUES (';'), (','), (':')) t(delimiter)", "supplier")
def delimiter_sniff(spark, supplier):
    found = [delimited.sniff(spark, as_csv(supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), m)) for m in ";,:"]
    return spark.createDataFrame([(x,) for x in found], "delimiter string")


@query(
    """SELECT count(*) AS n_rows, min(k) AS low, max(k) AS high FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS k FROM lineitem WHERE l_extendedprice >= 10000)
    UNION ALL SELECT count(*), min(l_extendedprice), max(l_extendedprice) FROM lineitem WHERE l_extendedprice < 10000""",
    "lineitem",
)
def sort_entry(spark, lineitem):
    """The entry point on a delimited dataset, written and read again."""
    path, out = as_csv(lineitem.select("l_orderkey", "l_extendedprice"), ","), shared.shared_path(spark, "sorted")
    sort.sort(spark, path, 1, ["int64", "float64"], bounds=[0.0, 10_000.0], output=out)
    return spark.read.parquet(out).groupBy(sort.SEGMENT).agg(F.count(F.lit(1)).alias("n_rows"), F.min("1").alias("low"), F.max("1").alias("high")).drop(sort.SEGMENT)


WORDS_SQL = r"SELECT {c}, unnest(regexp_split_to_array(text, '\s+')) AS word FROM {t}"


@query(f"SELECT word, count(*) AS n FROM ({WORDS_SQL.format(c='doc_id', t='documents')}) WHERE word <> '' GROUP BY word", "documents")
def word_count(spark, documents):
    words = documents.select(F.explode(scalars.split_words(F.col("text"))).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT conv_id, count(*) AS words FROM ({WORDS_SQL.format(c='conv_id', t='conversations')}) WHERE word <> '' GROUP BY conv_id", "conversations")
def word_total_per_object(spark, conversations):
    rows = conversations.select("conv_id", F.size(scalars.words(F.col("text"))).cast("long").alias("n")).filter("n > 0")
    return rows.groupBy("conv_id").agg(F.sum("n").alias("words"))


def count_words(obj):
    return Counter(w for line in obj.data_stream for w in line.decode().split())


def total(results):
    return sum(sum(c.values()) for c in results)


@query(f"SELECT source AS object, count(*) AS words FROM ({WORDS_SQL.format(c='source', t='documents')}) WHERE word <> '' GROUP BY source ORDER BY source LIMIT 5", "documents")
def map_reduce_per_object(spark, documents):
    """Calls over byte ranges of objects, and a reducer for each object."""
    path = shared.shared_path(spark, "objects")
    first = [r[0] for r in documents.select("source").distinct().orderBy("source").limit(5).collect()]
    rows = documents.filter(F.col("source").isin(first)).select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"), "source")
    rows.repartition("source").write.partitionBy("source").text(path)
    sums = mapreduce.map_reduce_parts(objects.parts(spark, path, chunk_size=20_000), count_words, total, "long")
    name = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return sums.groupBy(name.alias("object")).agg(F.sum("result").alias("words"))


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT)), (1, 1), (2, 4), (3, 9)) t(x, square)")
def stored_objects(spark):
    """Values put down by calls and taken up by others."""
    pool = mapreduce.Executor(spark)
    put = pool.get_result(pool.map(lambda x, storage: storage.put_object(x * x), range(4)))
    got = pool.get_result(pool.map(lambda stored, storage: storage.get_object(stored), put))
    pool.clean()
    return spark.createDataFrame(list(enumerate(got)), "x long, square long")


@query("SELECT CAST(range + 1 AS BIGINT) AS x, CAST(0 AS BIGINT) AS first, CAST(range + 1 AS BIGINT) AS n FROM range(3)")
def nested_calls(spark):
    """Calls that ask for calls, which the driver makes."""
    pool = mapreduce.Executor(spark)
    got = pool.get_result(pool.map(lambda x: mapreduce.Calls(lambda y: y, list(range(x))), range(1, 4)))
    return spark.createDataFrame([(i + 1, min(v), len(v)) for i, v in enumerate(got)], "x long, first long, n long")


@query("SELECT o_orderpriority, CAST(sum(o_custkey * 2 + 1) AS BIGINT) AS total FROM orders GROUP BY 1", "orders")
def map_sum_reduce(spark, orders):
    rows = mapreduce.map_rows(orders, lambda x: int(x) * 2 + 1, ["o_custkey"], "long", "mapped")
    return rows.groupBy("o_orderpriority").agg(F.sum("mapped").alias("total"))


@query('SELECT x, y, x + y AS "result" FROM (VALUES (CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (2, 2), (3, 3), (4, 4)) t(x, y)')
def map_args_positional(spark):
    items = [[i, i] for i in range(1, 5)]
    futures = mapreduce.Executor(spark).map(lambda x, y: x + y, items)
    return spark.createDataFrame([(x, y, f.result()) for (x, y), f in zip(items, futures)], "x long, y long, result long")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS joined FROM events GROUP BY user_id", "events")
def concat_reduce(spark, events):
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return events.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda s: s["event_type"]), ",").alias("joined"))


@query("SELECT vec_id AS idx, CAST((vec_id // 20) * 20 + vec_id % 20 AS INTEGER) AS pixel FROM embeddings", "embeddings")
def pixel_index(spark, embeddings):
    return imaging.with_pixel(spectra(embeddings)).select("idx", "pixel")


@query("SELECT max(vec_id // 20) - min(vec_id // 20) + 1 AS nrows, max(vec_id % 20) - min(vec_id % 20) + 1 AS ncols FROM embeddings", "embeddings")
def image_dims(spark, embeddings):
    return imaging.dims(spectra(embeddings)).select("nrows", "ncols")


@query(f"SELECT vec_id AS idx, CAST(place AS DOUBLE) AS mz, CAST(v AS DOUBLE) AS intensity FROM ({PEAKS_SQL})", "embeddings")
def spectra_explode(spark, embeddings):
    return imaging.peaks(spectra(embeddings), "idx")


@query(
    f"""SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(coalesce(v, 0), 6) AS value FROM (SELECT y, x FROM
    (SELECT unnest(range((SELECT min(vec_id // 20) FROM embeddings), (SELECT max(vec_id // 20) + 1 FROM embeddings))) AS y), (SELECT unnest(range(0, 20)) AS x)) AS grid
    LEFT JOIN (SELECT vec_id // 20 AS y, vec_id % 20 AS x, sum(CAST(v AS DOUBLE)) AS v FROM ({PEAKS_SQL}) WHERE place BETWEEN 8 AND 12 GROUP BY 1, 2) USING (y, x)""",
    "embeddings",
)
def ion_image(spark, embeddings):
    return imaging.ion_image(spectra(embeddings), 10.0, 2.5, z=1).withColumn("value", F.round("value", 6))


@query("SELECT vec_id AS idx, list_transform(list_sort(embedding), lambda v: round(CAST(v AS DOUBLE), 6)) AS sorted_mz FROM embeddings", "embeddings")
def spectrum_sorted_arrays(spark, embeddings):
    s = spectra(embeddings)
    peaks = imaging.sorted_spectrum(F.col("intensity"), F.col("mz"))
    return s.select("idx", F.transform(peaks, lambda p: scalars.rounded(p["mz"], 6)).alias("sorted_mz"))


@query(f"SELECT count(*) AS n_spectra, CAST(sum(len(embedding)) AS BIGINT) AS n_values FROM embeddings", "embeddings")
def spectra_counts(spark, embeddings):
    return imaging.counts(spectra(embeddings))


RATES = {"read_bw": 60e6, "write_bw": 40e6, "read_ops": 900.0, "write_ops": 500.0}
SIZE, MEMORY = 20_000_000_000, 2048
CURVE_SQL = """SELECT p AS workers, round(greatest(2e10 / (60e6 * p), ceil(2e10 / (64 * p)) * p / 900) + greatest(2e10 / (40e6 * p), ceil(2e10 / (64 * p * p)) * p * p / 500)
    + greatest(2e10 / (60e6 * p), ceil(2e10 / (64 * p * p)) * p * p / 900) + greatest(2e10 / (40e6 * p), ceil(2e10 / (64 * p)) * p / 500), 4) AS seconds
    FROM (SELECT CAST(range AS BIGINT) AS p FROM range({low}, {high}))""".format(low=planner.worker_range(SIZE, MEMORY)[0], high=planner.worker_range(SIZE, MEMORY)[1] + 1)


@query(CURVE_SQL)
def worker_time_curve(spark):
    return planner.worker_curve(spark, SIZE, MEMORY, **RATES).withColumn("seconds", F.round("seconds", 4))


@query(f"SELECT arg_min(workers, (seconds, workers)) AS workers, min(seconds) AS seconds FROM ({CURVE_SQL})")
def optimal_workers(spark):
    curve = planner.worker_curve(spark, SIZE, MEMORY, **RATES).withColumn("seconds", F.round("seconds", 4))
    return planner.best_workers(curve)


TASKS_SQL = "SELECT event_id AS task, least(value / 400, 1.0) AS progress, 20.0 + user_id % 50 AS elapsed, event_type = 'view' AS repeated FROM events"


def tasks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("task"),
        F.least(F.col("value") / 400, F.lit(1.0)).alias("progress"),
        (20.0 + F.col("user_id") % 50).cast("double").alias("elapsed"),
        (F.col("event_type") == "view").alias("repeated"),
    )


@query(f"SELECT task, round(CASE WHEN progress >= 1 THEN 0 WHEN progress > 0 THEN (1 - progress) / (progress / CAST(elapsed AS DOUBLE)) END, 6) AS seconds_left FROM ({TASKS_SQL})", "events")
def straggler_estimates(spark, events):
    return tasks(events).select("task", F.round(planner.remaining(F.col("progress"), F.col("elapsed")), 6).alias("seconds_left"))


@query(
    f"""WITH t AS ({TASKS_SQL}), s AS (SELECT quantile_cont(progress, 0.2) AS q, max(elapsed) AS newest FROM t)
    SELECT arg_max(task, (secs, task)) AS task, round(max(secs), 6) AS seconds_left FROM (
      SELECT task, (1 - progress) / (progress / CAST(elapsed AS DOUBLE)) AS secs FROM t, s WHERE progress < q AND progress < 1 AND NOT repeated AND elapsed >= greatest(0.15 * newest, 10))""",
    "events",
)
def straggler_pick(spark, events):
    return planner.pick_straggler(tasks(events)).select("task", F.round("left", 6).alias("seconds_left"))


@query(
    """SELECT r AS repeated, n AS total, f AS finished, CASE WHEN r > 10 THEN 'too many repeated' WHEN 10 * r >= n THEN 'share repeated' WHEN n - f <= 0 THEN 'all finished'
    WHEN 5 * (n - f) < n THEN 'few left' WHEN n - f < 7 THEN 'under seven left' ELSE 'go on' END AS verdict
    FROM (SELECT range AS r FROM range(13)), (SELECT unnest([20, 100]) AS n), (SELECT range AS i FROM range(21)), LATERAL (SELECT CAST(i * n // 20 AS BIGINT) AS f)"""
)
def stop_rule(spark):
    grid = spark.range(13 * 21 * 2).select((F.col("id") % 13).alias("repeated"), F.expr("if(id div 273 = 0, 20, 100)").alias("total"), F.expr("(id div 13) % 21").alias("i"))
    grid = grid.select("repeated", "total", F.expr("i * total div 20").alias("finished"))
    return grid.withColumn("verdict", planner.stop_rule(F.col("repeated"), F.col("total"), F.col("finished")))


@query("SELECT n, CAST(n AS DOUBLE) > 0.2 * 20 AS picked FROM (SELECT unnest([3, 4, 5, 9]) AS n)", "events")
def straggler_eligibility(spark, events):
    """A task is picked only once over a fifth of a job's tasks (20 here) have reported."""
    one = tasks(events).filter("not repeated and progress < 1").orderBy("task").limit(9)
    rows = [(n, planner.pick_straggler(one.orderBy("task").limit(n).withColumn("elapsed", F.lit(100.0)), 20).count() == 1) for n in (3, 4, 5, 9)]
    return spark.createDataFrame(rows, "n int, picked boolean")


@query(
    """WITH c AS (SELECT epoch(ts) - (SELECT epoch(min(ts)) FROM events) AS s, value AS d FROM events), b AS (SELECT range AS bin FROM range(600))
    SELECT bin, count(s) AS n FROM b LEFT JOIN c ON bin * (600.0 / 599) >= s % 600 AND bin * (600.0 / 599) < s % 600 + d GROUP BY bin""",
    "events",
)
def active_call_histogram(spark, events):
    first = events.agg(F.min("ts").alias("t0"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    calls = events.join(F.broadcast(first)).select(((seconds(F.col("ts")) - seconds(F.col("t0"))) % 600).alias("s"), "value")
    return planner.active_histogram(calls, F.col("s"), F.col("s") + F.col("value"))


@query(
    """SELECT e.event_id AS call_id, m.event_type, round(epoch(e.ts) - (SELECT epoch(min(ts)) FROM events), 3) AS start_offset,
    round((epoch(e.ts) + e.value) - (SELECT epoch(min(ts)) FROM events), 3) AS end_offset FROM events e JOIN events m USING (event_id)""",
    "events",
)
def call_timeline(spark, events):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    first = events.agg(F.min(at).alias("t0"))
    status = events.select(F.col("event_id").alias("call_id"), at.alias("start"), (at + F.col("value")).alias("end")).join(F.broadcast(first))
    meta = events.select(F.col("event_id").alias("call_id"), "event_type")
    out = planner.timeline(status, meta, F.col("t0"))
    return out.select("call_id", "event_type", F.round("start_offset", 3).alias("start_offset"), F.round("end_offset", 3).alias("end_offset"))


@query(
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance,
    round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(value)), 5) AS ci_low, round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(value)), 5) AS ci_high FROM events GROUP BY 1""",
    "events",
)
def running_stats_ci(spark, events):
    s = planner.running_stats(events, "event_type", "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"))


@query("SELECT max(total) AS best FROM (SELECT l_linenumber AS workers, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1)", "lineitem")
def aggregate_throughput(spark, lineitem):
    rates = planner.throughput(lineitem.select(F.col("l_linenumber").alias("workers"), F.col("l_quantity").alias("rate")))
    return rates.agg(F.round(F.max("total"), 2).alias("best"))


LETTER_SQL = "repeat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((id + {k}) % 26 + 1 AS BIGINT), 1), {n})"


@query(
    "SELECT substr(translate(md5('1:' || id), '0123456789abcdef', 'ABCDEFGHIJKLMNOP'), 1, 10) AS key, lpad(CAST(id AS VARCHAR), 10, '0') AS row, "
    + " || ".join(LETTER_SQL.format(k=k, n=8 if k == 7 else 10) for k in range(8))
    + " AS filler FROM (SELECT range AS id FROM range(5000))"
)
def teragen_rows(spark):
    return teragen.rows(spark, 5000)


@query(
    """SELECT g, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM (SELECT event_id, CAST(ntile(7) OVER (ORDER BY event_id) - 1 AS INTEGER) AS g FROM events) GROUP BY g""",
    "events",
)
def spectrum_ranges(spark, events):
    first = events.agg(F.min("event_id").alias("e0"))
    rows = events.select("event_id").join(F.broadcast(first)).withColumn("idx", F.col("event_id") - F.col("e0"))
    return imaging.spectrum_groups(rows, 7).groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


DRAW_SQL = "(CAST('0x' || substr(md5({k}), 1, 13) AS BIGINT) / 4503599627370496.0)"
POINTS = 500_000


@query(f"SELECT 4.0 * avg(CASE WHEN pow({DRAW_SQL.format(k="'x:' || id")}, 2) + pow({DRAW_SQL.format(k="'y:' || id")}, 2) <= 1 THEN 1 ELSE 0 END) AS pi FROM (SELECT range AS id FROM range({POINTS}))")
def pi_estimate(spark):
    inside = F.pow(scalars.draw("x", F.col("id")), 2) + F.pow(scalars.draw("y", F.col("id")), 2) <= 1
    return spark.range(POINTS).agg((4 * F.avg(inside.cast("double"))).alias("pi"))


NORMAL_SQL = f"sqrt(-2 * ln(1 - {DRAW_SQL.format(k="'a:' || forecast || ':' || day")})) * cos(2 * pi() * {DRAW_SQL.format(k="'b:' || forecast || ':' || day")})"


@query(f"SELECT forecast, round(100.0 * exp(sum(0.0002 + 0.01 * {NORMAL_SQL})), 6) AS price FROM (SELECT range AS forecast FROM range(100)), (SELECT unnest(range(1, 366)) AS day) GROUP BY forecast")
def stock_forecast(spark):
    days = spark.range(100).select(F.col("id").alias("forecast"), F.explode(F.sequence(F.lit(1), F.lit(365))).alias("day"))
    step = 0.01 * scalars.normal_draw(F.col("forecast"), F.col("day"))
    days = days.withColumn("price", scalars.log_normal_path(100.0, 0.0002, step, ["forecast"], "day"))
    w = Window.partitionBy("forecast")
    return days.withColumn("last", F.max("day").over(w)).filter("day = last").select("forecast", F.round("price", 6).alias("price"))


@query(
    f"""SELECT (o_orderkey - low) * 8 // (high - low + 1) AS stratum, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total
    FROM orders, (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders) WHERE {DRAW_SQL.format(k="'sample:' || o_orderkey")} < 0.05 GROUP BY 1""",
    "orders",
)
def stratified_sample(spark, orders):
    rows = ranges.stratified_sample(orders.select("o_orderkey"), 0.05, 8, place="o_orderkey", draw=scalars.draw("sample", F.col("o_orderkey")))
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query("SELECT range AS block, CASE WHEN range < 3 THEN 65536 ELSE 1000 END AS bytes FROM range(4)")
def random_blocks(spark):
    return randombytes.blocks(spark, 3 * 65_536 + 1000, 7, 65_536).select("block", F.octet_length("data").alias("bytes"))


@query("SELECT unnest([1, 2]) AS workers, true AS positive")
def probe_table(spark):
    rates = planner.probe_storage(spark, shared.shared_path(spark, "probe"), [1, 2], 1)
    return rates.select("workers", (F.least("read_bw", "write_bw", "read_ops", "write_ops") > 0).alias("positive"))
