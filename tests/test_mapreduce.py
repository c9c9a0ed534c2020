"""Calls, futures and reducers, over items and over parts of objects."""

import ast
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.compare import difference
from tidemark.operators import mapreduce
from tidemark.plans import catalog
from tidemark.sources import objects


def add(x, y):
    return x + y


def double(x):
    return 2 * x


def count_words(obj, id):
    return Counter(w for line in obj.data_stream for w in line.decode().split())


def total(results):
    return sum(sum(c.values()) for c in results)


@pytest.fixture
def pool(spark):
    return mapreduce.Executor(spark)


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    """Three objects and an empty one, with lines of many lengths, blank lines and no line end at the end of one."""
    rng = random.Random(1)
    top = tmp_path_factory.mktemp("shelf")
    for name in ("a", "b b", "c"):
        lines = [" ".join("w%d" % rng.randrange(50) for _ in range(rng.choice([0, 1, 3, 400]))) for _ in range(200)]
        (top / f"{name}.txt").write_text("\n".join(lines) + ("" if name == "c" else "\n"))
    (top / "empty.txt").write_text("")
    return str(top)


def test_arguments_are_bound():
    assert mapreduce.bind(add, [[1, 2], (3, 4)]) == [{"x": 1, "y": 2}, {"x": 3, "y": 4}]
    assert mapreduce.bind(add, [{"x": 2, "y": 8}] * 2) == [{"x": 2, "y": 8}] * 2
    assert mapreduce.bind(double, range(2)) == mapreduce.bind(double, {0, 1}) == [{"x": 0}, {"x": 1}]
    assert mapreduce.bind(double, 5) == [{"x": 5}]
    assert mapreduce.bind(add, [[1], [2]], [10]) == [{"x": 1, "y": 10}, {"x": 2, "y": 10}]
    assert mapreduce.bind(add, [{"x": 1}], {"y": 3}) == [{"x": 1, "y": 3}]
    for items, extra, error in (([[1]], {"y": 1}, TypeError), ([{"x": 1}], [1], TypeError), ([[1, 2, 3]], None, ValueError), ([{"x": 1}], None, ValueError), ([{"x": 1, "y": 2, "z": 3}], None, ValueError)):
        with pytest.raises(error):
            mapreduce.bind(add, items, extra)


def test_results_in_order(pool):
    assert [f.result() for f in pool.map(add, [[i, i] for i in range(1, 5)])] == [2, 4, 6, 8]
    assert pool.get_result() == [2, 4, 6, 8]
    assert pool.map(double, [21]).result() == 42 and pool.get_result() == 42
    assert pool.call_async(add, [3, 4]).result() == 7 and pool.call_async(add, {"x": 3, "y": 5}).result() == 8
    assert pool.map(lambda x, id: id, ["p", "q"])[1].result() == 1
    assert pool.map(double, []) == []


def test_reducers(pool):
    futures = pool.map_reduce(add, [[i, i] for i in range(1, 5)], lambda results: sum(results))
    assert len(futures) == 5 and pool.get_result(futures) == 20
    grouped = pool.map_reduce(double, [1, 2, 3], lambda results: results, groups=["g", "h", "g"])
    assert pool.get_result(grouped) == [[2, 6], [4]]
    with pytest.raises(ValueError):
        pool.map_reduce(double, [1, 2], sum, groups=["g"])


def test_errors_are_raised_where_they_are_read(pool):
    def fail(x):
        if x == 1:
            raise KeyError("one")
        return x

    futures = pool.map(fail, [0, 1, 2])
    assert futures[2].result() == 2
    with pytest.raises(KeyError):
        pool.get_result(futures)
    assert pool.get_result(pool.map(fail, [0, 1, 2], throw=False)) == [0, 2]
    reduced = pool.map_reduce(fail, [0, 1], sum)
    with pytest.raises(KeyError):
        reduced[-1].result()


def test_wait(pool):
    futures = pool.map(lambda x: time.sleep(x), [0.0, 0.2])
    done, left = pool.wait(futures)
    assert len(done) == 2 and not left
    assert pool.wait(futures, mapreduce.ALWAYS)[0] == done
    assert pool.get_result(futures) == []


def test_every_line_is_in_one_part(shelf):
    for name in ("a.txt", "b b.txt", "c.txt"):
        path = f"{shelf}/{name}"
        data = open(path, "rb").read()
        for chunk in (1, 7, 100, 5000, len(data) - 1):
            starts = range(0, len(data), chunk) if chunk > 50 else range(0, 2000, chunk)
            got = b"".join(objects.ObjectPart(path, len(data), k, at, chunk).data_stream.read() for k, at in enumerate(starts))
            assert data.startswith(got) and (chunk <= 50 or got == data)
    whole = objects.ObjectPart("file:///bucket/in/side.txt", 10)
    assert (whole.bucket, whole.key, whole.data_byte_range) == ("bucket", "in/side.txt", None)


def test_objects_are_mapped_in_parts(spark, pool, shelf):
    want = sum(len(open(f"{shelf}/{n}").read().split()) for n in os.listdir(shelf))
    sizes = [s for s in (os.path.getsize(f"{shelf}/{n}") for n in os.listdir(shelf)) if s]
    for cut, n in (({}, 3), ({"chunk_number": 2}, 6), ({"chunk_size": 20_000}, sum(-(-s // 20_000) for s in sizes))):
        futures = pool.map_reduce(count_words, shelf + "/", total, **cut)
        assert pool.get_result(futures) == want and len(futures) == n + 1
        futures = pool.map_reduce(count_words, [f"{shelf}/{x}" for x in ("a.txt", "b b.txt", "c.txt")], total, reducer_per_object=True, **cut)
        assert sum(pool.get_result(futures)) == want and len(futures) == n + 3
    further = pool.map(lambda obj, k: (obj.key.rpartition("/")[2], k), [{"obj": f"{shelf}/a.txt", "k": 5}, {"obj": f"{shelf}/c.txt", "k": 6}])
    assert pool.get_result(further) == [("a.txt", 5), ("c.txt", 6)]
    with pytest.raises(ValueError):
        pool.map_reduce(double, [1], sum, reducer_per_object=True)
    with pytest.raises(Exception, match="(?i)path"):
        pool.map(count_words, f"{shelf}/missing.txt")


def test_parts_are_mapped_without_the_driver(spark, shelf):
    parts = objects.parts(spark, shelf, chunk_size=20_000)
    rows = mapreduce.map_parts(parts, lambda obj: len(obj.data_stream.read().split()), "long")
    got = {r["path"].rpartition("/")[2]: r["n"] for r in rows.groupBy("path").agg(F.sum("result").alias("n")).collect()}
    assert got == {n: len(open(f"{shelf}/{n}").read().split()) for n in ("a.txt", "b b.txt", "c.txt")}


def test_values_pass_through_the_storage(spark, pool):
    put = pool.get_result(pool.map(lambda x, storage: storage.put_object([x], f"k/{x}"), range(3)))
    assert pool.get_result(pool.map(lambda stored, storage: storage.get_object(stored), put)) == [[0], [1], [2]]
    assert pool.storage.get_object(put[2]) == [2]
    assert pool.clean(f"{pool.storage.root}/k/1") == 1 and pool.clean() == 1 and pool.clean() == 0


def test_calls_that_take_too_long_or_too_much(spark):
    def sleep(x):
        time.sleep(x)
        return x

    pool = mapreduce.Executor(spark, timeout=0.3, most_arguments=10_000)
    futures = pool.map(sleep, [0.0, 30.0])
    assert futures[0].result() == 0.0
    with pytest.raises(TimeoutError):
        futures[1].result()
    with pytest.raises(ValueError):
        pool.map(double, ["x" * 20_000])


def test_calls_that_die(spark):
    pool = mapreduce.Executor(spark)
    with pytest.raises(MemoryError):
        pool.map(lambda x: os._exit(1), [1]).result()


def test_calls_that_ask_for_calls(pool):
    nested = pool.map(lambda x: mapreduce.Calls(lambda y: y + 1, list(range(x))), range(1, 5))
    assert pool.get_result(nested) == [[1], [1, 2], [1, 2, 3], [1, 2, 3, 4]]
    twice = pool.call_async(lambda x: mapreduce.Calls(lambda y: mapreduce.Calls(lambda z: z, [y]), [x, x + 1]), 3)
    assert pool.get_result(twice) == [[3], [4]]


def test_urls_are_mapped_in_ranges(pool, shelf, monkeypatch):
    import http.server
    import threading

    from tidemark.sources import urls

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.answer(False)

        def do_GET(self):
            self.answer(True)

        def answer(self, body):
            data = open(shelf + "/" + self.path.strip("/").replace("%20", " "), "rb").read()
            part = data
            if said := self.headers.get("Range"):
                a, b = map(int, said.removeprefix("bytes=").split("-"))
                part = data[a : b + 1]
            self.send_response(206 if said else 200)
            self.send_header("Content-Length", str(len(part)))
            if "c.txt" not in self.path:
                self.send_header("Accept-Ranges", "bytes")
            self.end_headers()
            if body:
                self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        size = os.path.getsize(f"{shelf}/a.txt")
        assert [p.chunk_size for p in urls.parts(f"{at}/a.txt", 10_000)] == [None] and urls.parts(f"{at}/c.txt", 10_000, None, 1) == [urls.UrlPart(f"{at}/c.txt", os.path.getsize(f"{shelf}/c.txt"))]
        assert urls.parts(f"{at}/a.txt", 30_000, 3, 1)[0].chunk_size == 10_000 + size % 3
        for each in (7_001, size - 1, size):
            got = b"".join(p.data_stream.read() for p in urls.parts(f"{at}/a.txt", each, None, 1))
            assert got == open(f"{shelf}/a.txt", "rb").read()
        futures = pool.map_reduce(lambda url: len(url.data_stream.read().split()), [f"{at}/a.txt", f"{at}/c.txt"], sum, reducer_per_object=True)
        assert pool.get_result(futures) == [len(open(f"{shelf}/{n}").read().split()) for n in ("a.txt", "c.txt")]
    finally:
        server.shutdown()


def test_reducers_over_many_parts(spark, shelf, monkeypatch):
    rows = mapreduce.map_reduce_parts(objects.parts(spark, shelf, chunk_size=500), lambda obj: [obj.part, len(obj.data_stream.read().split())], lambda results: str(list(results)), "string")
    got = {r["path"].rpartition("/")[2]: r["result"] for r in rows.collect()}
    assert set(got) == {"a.txt", "b b.txt", "c.txt"}
    for name, said in got.items():
        found = ast.literal_eval(said)
        assert [k for k, _ in found] == list(range(-(-os.path.getsize(f"{shelf}/{name}") // 500)))
        assert sum(n for _, n in found) == len(open(f"{shelf}/{name}").read().split())
    monkeypatch.setattr(mapreduce.Executor.__init__, "__defaults__", (16, mapreduce.TIMEOUT, 1000))  # as 4 MB of arguments are to many objects
    sf_dir = "/root/testdata/sf0.001"
    assert difference(spark, sf_dir, catalog.QUERIES["map_reduce_per_object"], catalog.SQL["map_reduce_per_object"]) == ""
