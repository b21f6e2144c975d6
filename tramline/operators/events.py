"""Events handed to handlers, published again as topics, and jobs and tokens that follow from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class Bus:
    """Handlers with the events that each lets through; in batch a column, in a stream a sink for foreachBatch."""

    def __init__(self):
        self.guards: dict[str, Column] = {}
        self.calls: dict[str, Callable] = {}

    def add(self, handler: str, guard: Column, call: Callable | None = None) -> None:
        self.guards[handler] = guard
        if call:
            self.calls[handler] = call

    def notified(self, events: DataFrame) -> DataFrame:
        """Events with each `handler` that gets them."""
        names = F.array_compact(F.array(*(F.when(g, F.lit(h)) for h, g in self.guards.items())))
        return events.withColumn("handler", F.explode(names))

    def sink(self, events: DataFrame, batch: int) -> None:
        """Hands each handler its events of a micro-batch, one after the other; a handler that fails doesn't stop the others."""
        failed = []
        for handler, call in self.calls.items():
            try:
                call(events.where(self.guards[handler]), batch)
            except Exception as e:  # noqa: BLE001
                failed.append(f"{handler}: {e}")
        if failed:
            raise RuntimeError("; ".join(failed))


def meta_events(log: DataFrame, topics: dict[str, Column], subject: str) -> DataFrame:
    """`log` once for each meta topic whose condition holds, with `meta_topic` and `subject`."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in topics.items())))
    return log.withColumn("subject", F.col(subject)).withColumn("meta_topic", F.explode(names))


def first_jobs(jobs: DataFrame, part: str, order: str, n: int) -> DataFrame:
    """The first n jobs of each partition in order; Spark limits groups before the shuffle."""
    return jobs.withColumn("__k", F.row_number().over(Window.partitionBy(part).orderBy(order))).where(F.col("__k") <= n).drop("__k")


def shed(events: DataFrame, limit: int, bucket: Column, order: list[str]) -> DataFrame:
    """Events with `pooled`: the first `limit` of each time bucket go through the pool, others run in their caller."""
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return events.withColumn("__bucket", bucket).withColumn("pooled", place <= limit).drop("__bucket")


def fetches(asked: DataFrame, service: str, at: str, tie: str, lifetime: int) -> DataFrame:
    """How often each service's token was asked for, and how often fetched: where the last use is a lifetime ago or more,
    since each use refreshes the token."""
    before = F.lag(at).over(Window.partitionBy(service).orderBy(at, tie))
    new = before.isNull() | (F.col(at) - before >= lifetime)
    return asked.withColumn("__new", F.when(new, 1).otherwise(0)).groupBy(service).agg(F.count(F.lit(1)).alias("asked"), F.sum("__new").alias("fetched"))


class Callbacks:
    """Functions of columns under procedure names, checked for their number of arguments when they are registered and called."""

    def __init__(self):
        self.known: dict[str, tuple[Callable, int]] = {}

    def register(self, procedure: str, f: Callable, arguments: int) -> None:
        if not callable(f) or f.__code__.co_argcount != arguments:
            raise ValueError(f"{procedure} must be a function of {arguments} arguments")
        self.known[procedure] = f, arguments

    def answer(self, procedure: Column, arguments: list[Column]) -> Column:
        """What the procedure's function gives, or the URI of an error."""
        of = lambda f, n: f(*arguments) if n == len(arguments) else F.lit("wamp.error.invalid_argument")
        cases = [(procedure == name, of(f, n)) for name, (f, n) in self.known.items()]
        return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), cases, F.lit("wamp.error.no_such_procedure"))


@udtf(returnType="place: bigint, name: string")
class Listed:
    """A procedure that returns a list: the first n names of a realm."""

    def eval(self, realm: str, n: int):
        for i in range(1, n + 1):
            yield i, f"{realm}.{i}"
