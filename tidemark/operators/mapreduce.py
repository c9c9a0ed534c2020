"""Python functions over items, and their reduction, as Spark jobs behind futures.

Arguments are bound on the driver; each item is one row of a table, dealt out
over tasks, and results come back in the order of the items.
"""

from __future__ import annotations

import concurrent.futures as cf
import inspect
import itertools
import signal
import traceback
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import shared
from tidemark.operators.store import Storage
from tidemark.sources import objects, urls

#: Parameter names that the executor fills in.
RESERVED = ("id", "storage")
#: Seconds of a call, and bytes of all arguments of a job, that aren't exceeded.
TIMEOUT, MOST_ARGUMENTS = 595.0, 4 << 20
ALL, ANY, ALWAYS = "ALL_COMPLETED", "ANY_COMPLETED", "ALWAYS"


def bind(func: Callable, items: Any, extra: Any = None) -> list[dict]:
    """Keyword arguments of each call: lists by place, dicts by name, anything else as the first parameter."""
    if isinstance(items, (range, set, frozenset)) or not isinstance(items, (list, tuple)) and isinstance(items, Iterable) and not isinstance(items, (str, bytes, dict)):
        items = list(items)
    elif not isinstance(items, (list, tuple)):
        items = [items]
    names = [n for n, p in inspect.signature(func).parameters.items() if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)]
    open_names = any(p.kind is p.VAR_KEYWORD for p in inspect.signature(func).parameters.values())
    free = [n for n in names if n not in RESERVED]
    needed = [n for n in free if inspect.signature(func).parameters[n].default is inspect.Parameter.empty]
    out = []
    for x in items:
        if isinstance(x, dict) and (set(x) & set(free) or open_names and x):
            call = dict(x)
            if extra is not None:
                if not isinstance(extra, dict):
                    raise TypeError("extra parameters must be a dict, as the items are")
                call |= extra
        else:
            values = list(x) if isinstance(x, (list, tuple)) else [x]
            if extra is not None:
                if isinstance(extra, dict):
                    raise TypeError("extra parameters must be a list, as the items are")
                values += list(extra) if isinstance(extra, (list, tuple)) else [extra]
            if len(values) > len(free):
                raise ValueError(f"{len(values)} arguments for {free}")
            call = dict(zip(free, values))
        if missing := [n for n in needed if n not in call]:
            raise ValueError(f"arguments without a value: {missing}")
        if not open_names and (unknown := [n for n in call if n not in free]):
            raise ValueError(f"unknown arguments: {unknown}")
        out.append(call)
    return out


class RemoteError(RuntimeError):
    """A call's exception that can't be sent as it is."""


class Results(cf.Future):
    """Of one call. Results of calls that a reducer takes are no output."""

    output = True


@dataclass(frozen=True)
class Calls:
    """What a function returns to have further calls made for it: its result becomes the list of theirs.

    Functions can't start Spark jobs on executors; the driver makes these calls.
    """

    func: Callable
    items: Any
    extra: Any = None


def url_calls(items: Any, chunk_size: int | None = None, chunk_number: int | None = None) -> list[dict]:
    """A call for each part of the objects at the URLs, in their order. Items may be dicts with ``url`` and further arguments."""
    items = items if isinstance(items, (list, tuple, set, frozenset)) else [items]
    given = [x if isinstance(x, dict) else {"url": x[0] if isinstance(x, (list, tuple)) else x} for x in items]
    with cf.ThreadPoolExecutor(32) as pool:
        found = list(pool.map(lambda x: urls.parts(x["url"], chunk_size, chunk_number), given))
    return [x | {"url": p} for x, ps in zip(given, found) for p in ps]


def alarmed(seconds: float | None, function: Callable, **given: Any) -> Any:
    """The function's value, or TimeoutError after so many seconds."""
    if not seconds:
        return function(**given)

    def late(*_: Any) -> None:
        raise TimeoutError(f"function exceeded maximum time of {seconds} seconds")

    was = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return function(**given)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, was)


def object_calls(spark: SparkSession, items: Any, chunk_size: int | None = None, chunk_number: int | None = None) -> list[dict]:
    """A call for each part of the objects at the paths or below the prefixes, objects by path and parts in order. Items may be dicts with ``obj`` and further arguments."""
    items = items if isinstance(items, (list, tuple, set, frozenset)) else [items]
    given = [x if isinstance(x, dict) else {"obj": x[0] if isinstance(x, (list, tuple)) else x} for x in items]
    objects.one_backend([x["obj"] for x in given])
    alone = [x for x in given if len(x) == 1]  # listed by one job
    groups = ([([x["obj"] for x in alone], {})] if alone else []) + [([x["obj"]], x) for x in given if len(x) > 1]
    out = []
    for paths, further in groups:
        found = objects.parts(spark, paths, chunk_size, chunk_number).orderBy("path", "part").collect()
        out += [further | {"obj": objects.ObjectPart(**r.asDict())} for r in found]
    return out


def call_table(spark: SparkSession, func: Callable, calls: list[dict], partitions: int | None = None, storage: Storage | None = None, timeout: float | None = None) -> DataFrame:
    """call long, ok boolean, value binary (pickled result or exception), trace string."""
    wants = [n for n in RESERVED if n in inspect.signature(func).parameters]
    sent = cloudpickle.dumps((func, wants))
    rows = [(i, cloudpickle.dumps(c)) for i, c in enumerate(calls)]
    n = partitions or max(1, min(len(rows), 4096))
    table = spark.createDataFrame(rows, "call long, args binary").repartitionById(n, F.pmod("call", F.lit(n)).cast("int"))

    def run(batches):
        import pickle

        function, given = pickle.loads(sent)
        for b in batches:
            out = []
            for i, args in zip(b["call"], b["args"]):
                try:
                    fill = {"id": int(i), "storage": storage}
                    value = alarmed(timeout, function, **pickle.loads(args), **{k: fill[k] for k in given})
                    out.append((i, True, cloudpickle.dumps(value), None))
                except Exception as e:
                    trace = traceback.format_exc()
                    try:
                        value = cloudpickle.dumps(e)
                        pickle.loads(value)
                    except Exception:
                        value = cloudpickle.dumps(RemoteError(repr(e)))
                    out.append((i, False, value, trace))
            yield pd.DataFrame(out, columns=["call", "ok", "value", "trace"])

    return table.mapInPandas(run, "call long, ok boolean, value binary, trace string")


class Executor:
    """Runs calls; keeps the futures it gave so that ``get_result`` can gather them."""

    def __init__(self, spark: SparkSession, threads: int = 16, timeout: float | None = TIMEOUT, most_arguments: int = MOST_ARGUMENTS):
        self.spark, self.pool = spark, cf.ThreadPoolExecutor(threads)
        self.futures: list[cf.Future] = []
        self.read: set[int] = set()
        self.id = uuid.uuid4().hex
        self.timeout, self.most_arguments = timeout, most_arguments
        self.storage = Storage(shared.shared_path(spark, f"objects-{self.id}"))

    def _rows(self, func: Callable, calls: list[dict]) -> list[tuple[int, bool, Any]]:
        """(call, ok, result or exception) of every call; calls that a result asks for are made too."""
        import pickle

        try:
            rows = call_table(self.spark, func, calls, None, self.storage, self.timeout).collect()
        except Exception as e:  # the worker of a call died again and again: for want of memory, nearly always
            if any(x in str(e) for x in ("Python worker exited unexpectedly", "OutOfMemoryError", "ExecutorLostFailure", "MemoryError")):
                raise MemoryError("function exceeded maximum memory and was killed") from e
            raise
        return [(r["call"], r["ok"], self._follow(pickle.loads(r["value"])) if r["ok"] else pickle.loads(r["value"])) for r in rows]

    def _follow(self, value: Any) -> Any:
        """The value; the results of the calls that it asks for; what a future in it gives."""
        if isinstance(value, Calls):
            out = [None] * len(calls := self._calls(value.func, value.items, value.extra, None, None))
            for i, ok, x in self._rows(value.func, calls):
                if not ok:
                    raise x
                out[i] = x
            return out
        if isinstance(value, cf.Future):
            return self._follow(value.result())
        if isinstance(value, list) and any(isinstance(x, (Calls, cf.Future)) for x in value):
            return [self._follow(x) for x in value]
        return value

    def _submit(self, func: Callable, calls: list[dict], throw: bool = True, guard: bool = True) -> list[cf.Future]:
        size = sum(len(cloudpickle.dumps(c)) for c in calls)
        if guard and size > self.most_arguments:
            raise ValueError(f"{size} bytes of arguments, {self.most_arguments} are allowed: put them into the storage, or map a table")
        futures: list[cf.Future] = [Results() for _ in calls]

        def job() -> None:
            try:
                for call, ok, value in self._rows(func, calls):
                    f = futures[call]
                    if ok:
                        f.set_result(value)
                    elif throw:
                        f.set_exception(value)
                    else:
                        f.set_result(None)
            except BaseException as e:
                for f in futures:
                    if not f.done():
                        f.set_exception(e)

        self.pool.submit(job)
        self.futures += futures
        return futures

    def call_async(self, func: Callable, data: Any, throw: bool = True) -> cf.Future:
        items = data if isinstance(data, dict) else [data] if not isinstance(data, (list, tuple)) else [list(data)]
        return self._submit(func, bind(func, [items] if isinstance(items, dict) else items), throw)[0]

    def _calls(self, func: Callable, items: Any, extra: Any, chunk_size: int | None, chunk_number: int | None) -> list[dict]:
        names = inspect.signature(func).parameters
        if "obj" not in names and "url" not in names:
            return bind(func, items, extra)
        if extra is not None and not isinstance(extra, dict):
            raise TypeError("extra parameters must be a dict where the items are objects")
        calls = object_calls(self.spark, items, chunk_size, chunk_number) if "obj" in names else url_calls(items, chunk_size, chunk_number)
        return bind(func, calls, extra)

    def map(self, func: Callable, items: Any, extra: Any = None, throw: bool = True, chunk_size: int | None = None, chunk_number: int | None = None) -> list[cf.Future] | cf.Future:
        """One call for each item; futures in the items' order, one alone for a single item.

        Of a function with a parameter ``obj`` the items are paths or prefixes,
        of one with ``url`` they are URLs, and each part of each object is a call.
        """
        futures = self._submit(func, self._calls(func, items, extra, chunk_size, chunk_number), throw)
        return futures[0] if len(futures) == 1 else futures

    def map_reduce(self, func: Callable, items: Any, reduce_func: Callable, extra: Any = None, groups: list | None = None, chunk_size: int | None = None, chunk_number: int | None = None, reducer_per_object: bool = False) -> list[cf.Future]:
        """The futures of the calls, then those of the reducers: one over all results in order, one for each object, or one for each group of consecutive items (``groups``: a name for each item).

        ``get_result`` gives what the reducers return.
        """
        calls = self._calls(func, items, extra, chunk_size, chunk_number)
        if reducer_per_object:
            if any("obj" not in c and "url" not in c for c in calls):
                raise ValueError("a reducer for each object needs a function of obj or url")
            groups = [(c.get("obj") or c.get("url")).path for c in calls]
        if groups and len(groups) != len(calls):
            raise ValueError(f"{len(groups)} group names for {len(calls)} calls")
        names = list(dict.fromkeys(groups)) if groups else [None]
        mapped = self._submit(func, calls)
        for f in mapped:
            f.output = False

        def reduce_job() -> None:
            try:
                values = [f.result() for f in mapped]
                lists = [values]
                if groups:
                    by: dict = {name: [] for name in names}
                    for v, g in zip(values, groups):
                        by[g].append(v)
                    lists = list(by.values())
                for f, r in zip(out, self.spark_results(reduce_func, lists)):
                    f.set_result(r)
            except BaseException as e:
                for f in out:
                    if not f.done():
                        f.set_exception(e)

        out: list[cf.Future] = [Results() for _ in names]
        self.pool.submit(reduce_job)
        self.futures += out
        return [*mapped, *out]

    def spark_results(self, func: Callable, lists: list[list]) -> list:
        first = next(iter(inspect.signature(func).parameters.values()))
        name = first.name
        if first.kind is first.POSITIONAL_ONLY:  # builtins like sum
            name, func = "results", lambda results, reducer=func: reducer(results)
        out = [None] * len(lists)
        for call, ok, value in self._rows(func, [{name: x} for x in lists]):
            if not ok:
                raise value
            out[call] = value
        return out

    def wait(self, futures: Iterable[cf.Future] | None = None, return_when: str = ALL, timeout: float | None = None) -> tuple[list, list]:
        """(done, not done)."""
        fs = list(self.futures if futures is None else [futures] if isinstance(futures, cf.Future) else futures)
        if return_when != ALWAYS:
            cf.wait(fs, timeout, cf.ALL_COMPLETED if return_when == ALL else cf.FIRST_COMPLETED)
        return [f for f in fs if f.done()], [f for f in fs if not f.done()]

    def get_result(self, futures: Any = None, timeout: float | None = None) -> Any:
        """Results in order, one alone as it is; of the executor's own futures those not read before. Calls that returned None give no entry."""
        if futures is None:
            fs = [f for f in self.futures if id(f) not in self.read]
        else:
            fs = [futures] if isinstance(futures, cf.Future) else list(futures)
        fs = [f for f in fs if getattr(f, "output", True)]
        out = [self._follow(f.result(timeout)) for f in fs]
        self.read |= {id(f) for f in fs}
        return out[0] if len(fs) == 1 else [x for x in out if x is not None]

    def clean(self, prefix: str | None = None) -> int:
        """Forget the futures and delete the values that calls put down, or else what lies below a path prefix; how many files and folders went."""
        if prefix is None:
            self.futures.clear()
            self.read.clear()
        return shared.delete_prefix(self.spark, prefix or self.storage.root)


def map_parts(parts: DataFrame, func: Callable, returns: str) -> DataFrame:
    """path, part and the column ``result`` of a function of an ``ObjectPart``; nothing passes through the driver. parts: of ``objects.parts``."""
    n = parts.sparkSession.sparkContext.defaultParallelism * 4

    @F.pandas_udf(returns)
    def run(path: pd.Series, size: pd.Series, part: pd.Series, start: pd.Series, chunk: pd.Series) -> pd.Series:
        given = zip(path, size, part, start, chunk)
        return pd.Series([func(objects.ObjectPart(p, int(s), int(k), int(a), None if pd.isna(c) else int(c))) for p, s, k, a, c in given])

    dealt = parts.repartition(n, "path", "part")
    return dealt.select("path", "part", run("path", "size", "part", "start", "chunk_size").alias("result"))


def map_reduce_parts(parts: DataFrame, func: Callable, reduce_func: Callable, returns: str) -> DataFrame:
    """path and the column ``result``: what the reducer makes of the results of an object's parts, which it gets as an iterator in their order.

    Results are shuffled to the reducers' tasks, and a task holds one batch of them; nothing passes through the driver.
    """
    mapped = map_parts(parts, lambda obj: cloudpickle.dumps(func(obj)), "binary")

    def run(batches):
        import pickle

        rows = ((p, v) for b in batches for p, v in zip(b["path"], b["result"]))
        for path, group in itertools.groupby(rows, lambda r: r[0]):
            yield pd.DataFrame({"path": [path], "result": [reduce_func(pickle.loads(v) for _, v in group)]})

    dealt = mapped.repartition("path").sortWithinPartitions("path", "part")
    return dealt.select("path", "result").mapInPandas(run, f"path string, result {returns}")


def map_rows(df: DataFrame, func: Callable, columns: list[str], returns: str, name: str) -> DataFrame:
    """A Python function over rows of a table, a batch at a time."""

    @F.pandas_udf(returns)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([func(*x) for x in zip(*cols)])

    return df.withColumn(name, run(*columns))
