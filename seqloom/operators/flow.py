"""Composition: chaining, branches on a whole result, first success, timeouts. Driver-side, as they depend on results."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Expected:
    """A value or an error."""

    value: Any = None
    error: BaseException | None = None

    def get(self) -> Any:
        if self.error is not None:
            raise self.error
        return self.value

    @property
    def has_error(self) -> bool:
        return self.error is not None


class CombinedError(Exception):
    """All alternatives failed."""

    def __init__(self, errors: list[BaseException]):
        super().__init__("; ".join(map(str, errors)))
        self.errors = errors


def attempt(f: Callable[[], Any]) -> Expected:
    try:
        return Expected(f())
    except Exception as e:  # any failure is the result here
        return Expected(error=e)


def then(first: Callable[[], Any] | Expected, f: Callable[[Expected], Any]) -> Any:
    """f gets the value or the error of what came before; a frame stays lazy."""
    return f(first if isinstance(first, Expected) else attempt(first))


def invoke(df: DataFrame, f: Callable[[Column], Column], col: str = "result", out: str = "result") -> DataFrame:
    """f of the one value of a one-row frame."""
    return df.select(f(F.col(col)).alias(out))


def all_of(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0]
    for df in frames[1:]:
        out = out.crossJoin(df)  # one row each
    return out


def any_of(*tasks: Callable[[], Any]) -> tuple[int, Any]:
    """Number and value of the task that first succeeds; CombinedError only if all fail. Others are left to end."""
    pool = ThreadPoolExecutor(max(1, len(tasks)))
    try:
        at = {pool.submit(t): i for i, t in enumerate(tasks)}
        errors = []
        for done in as_completed(at):
            if done.exception() is None:
                return at[done], done.result()
            errors.append(done.exception())
        raise CombinedError(errors)
    finally:
        pool.shutdown(wait=False)


def first_value(*cols: Column) -> Column:
    """The data form of any_of: the first alternative that is not null, with its number."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("index"), c.alias("value"))) for i, c in enumerate(cols)])


class Branch:
    """if_(...).else_if(...).else_(...): the first condition that holds for the result decides."""

    def __init__(self, value: Any, done: bool = False):
        self.value, self.done = value, done

    def else_if(self, cond: Callable[[Any], bool], f: Callable[[Any], Any]) -> Branch:
        if not self.done and cond(self.value):
            return Branch(f(self.value), True)
        return self

    def else_(self, f: Callable[[Any], Any]) -> Any:
        return self.value if self.done else f(self.value)


def if_(value: Any, cond: Callable[[Any], bool], f: Callable[[Any], Any]) -> Branch:
    return Branch(value).else_if(cond, f)


def if_then_else(value: Any, cond: Callable[[Any], bool], yes: Callable[[Any], Any], no: Callable[[Any], Any]) -> Any:
    return yes(value) if cond(value) else no(value)


def scalar(df: DataFrame) -> Any:
    """The one value of a one-row, one-column frame."""
    return df.first()[0]


def parallel_invoke(spark: SparkSession, *tasks: Callable[[], Any], timeout: float | None = None) -> list[Expected]:
    """All tasks at once, each in a thread; an Expected for each. Those not done in time are cancelled, Spark jobs too."""
    from pyspark import inheritable_thread_target

    sc, tag = spark.sparkContext, f"invoke-{uuid.uuid4().hex}"

    def run(f: Callable[[], Any]) -> Any:
        sc.addJobTag(tag)
        try:
            return f()
        finally:
            sc.removeJobTag(tag)

    pool = ThreadPoolExecutor(max(1, len(tasks)))
    began = [pool.submit(inheritable_thread_target(run), t) for t in tasks]
    clock = threading.Event()
    timer = threading.Timer(timeout, clock.set) if timeout is not None else None
    if timer:
        timer.start()
    out = []
    for f in began:
        while True:
            try:
                out.append(Expected(f.result(0.02 if timer else None)))
                break
            except Late as e:
                if f.done():
                    out.append(Expected(error=e))
                    break
                if clock.is_set():
                    sc.cancelJobsWithTag(tag)
                    out.append(Expected(error=TimeoutError(f"not done in {timeout} s")))
                    break
            except Exception as e:  # kept in its slot
                out.append(Expected(error=e))
                break
    if timer:
        timer.cancel()
    pool.shutdown(wait=False)
    return out


class Interruptible:
    """A job in a thread that interrupt() cancels with all its stages."""

    def __init__(self, spark: SparkSession, f: Callable[[], Any], callback: Callable[[Expected], Any] | None = None):
        from pyspark import InheritableThread

        self.tag, self.spark, self.result = f"job-{uuid.uuid4().hex}", spark, Expected(error=RuntimeError("not done"))

        def run() -> None:
            spark.sparkContext.addJobTag(self.tag)
            self.result = attempt(f)
            if callback:
                callback(self.result)

        self.thread = InheritableThread(target=run)
        self.thread.start()

    def interrupt(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> Expected:
        self.thread.join(seconds)
        return self.result


def best_partitions(df: DataFrame, run: Callable[[DataFrame], Any], counts: list[int], retries: int = 2) -> dict[int, float]:
    """Seconds by number of partitions, the best of some tries: how fine to cut a job."""
    import time

    out = {}
    for n in counts:
        times = []
        for _ in range(retries):
            t = time.perf_counter()
            run(df.repartition(n))
            times.append(time.perf_counter() - t)
        out[n] = min(times)
    return out
