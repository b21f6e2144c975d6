"""Reads and maintenance of keyed tables: last-writer-wins views, lookups by example, paging, flushes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: list[str], version: list[str], deleted: str | None = "deleted") -> DataFrame:
    """Last-writer-wins view of a change log, without tombstones. The greatest version is found by a partial aggregate, so a hot key costs no task its rows."""
    rest = [c for c in changes.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*version)).alias("row")
    out = changes.groupBy(*key).agg(row).select(*key, "row.*")
    return out.where(~F.col(deleted)) if deleted else out


def bound(**fields) -> Column:
    """Conjunction of equalities for the fields that aren't None; all rows if none is bound."""
    terms = [F.col(k).isin(v) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in fields.items() if v is not None]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def find(df: DataFrame, exclude: dict | None = None, limit: int | None = None, **fields) -> DataFrame:
    out = df.where(bound(**fields))
    if exclude:
        out = out.where(~bound(**exclude))
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, key: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next page in key order after a cursor (the last key seen): a filter and a top-k, never a skip."""
    if after is not None:
        terms = []
        for i, k in enumerate(key):
            terms.append(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(key[:i], after[:i], strict=True)], F.lit(True)) & (F.col(k) > after[i]))
        df = df.where(reduce(lambda a, b: a | b, terms))
    return df.orderBy(*key).limit(size)


def running(df: DataFrame, key: list[str], coarse: list[tuple[Column, bool]], order: list[Column], value: Column | None = None, name: str = "place") -> DataFrame:
    """`df` with the running sum of `value` (the row number by default) within a key, in the order of `coarse` and `order`.

    `coarse` are (column, falling) pairs that cut a key's rows into groups. Groups are summed up first, by partial aggregates, and
    only the rows of a group are sorted together; so a key may hold most of the table.
    """
    value = F.lit(1) if value is None else value
    names = [f"__g{i}" for i in range(len(coarse))]
    groups = df.withColumns({n: c for n, (c, _) in zip(names, coarse, strict=True)}).withColumn("__value", value)
    ordered = [F.col(n).desc() if falls else F.col(n).asc() for n, (_, falls) in zip(names, coarse, strict=True)]
    sums = groups.groupBy(*key, *names).agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*key).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(c).alias(f"__s{i}") for i, c in enumerate([*key, *names])), before.alias("__before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate([*key, *names])])
    inside = F.sum("__value").over(Window.partitionBy(*key, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return groups.join(sums, same).withColumn(name, F.col("__before") + inside).select(*df.columns, name)


def merged_pages(pages: list[DataFrame], key: list[str], size: int) -> DataFrame:
    """Pages of several indexes as one: the least rows of all. Each index goes on after the last key of the whole page."""
    return reduce(DataFrame.unionByName, pages).orderBy(*key).limit(size)


def owned_merge(own: DataFrame, other: DataFrame, owner: str, node: str) -> DataFrame:
    """Change logs of this node and of another: what the other says of entries that this node owns isn't believed."""
    return own.unionByName(other.where(F.col(owner) != node))


def take(df: DataFrame, taken: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is read destructively, and what is left."""
    return df.join(taken.select(*key).distinct(), key, "left_semi"), df.join(taken.select(*key).distinct(), key, "left_anti")


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose owner (a closed session, a node that is down) isn't among the gone."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def first_and_last(log: DataFrame, key: list[str], order: list[str], delta: str = "delta") -> DataFrame:
    """Running count of a key after each change, floored at zero, and whether the change created or deleted the key."""
    w = Window.partitionBy(*key).orderBy(*order)
    so_far = F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lowest = F.least(F.lit(0), F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = log.withColumn("sum", so_far).withColumn("count", F.col("sum") - lowest)
    return out.withColumn("created", (F.col(delta) > 0) & (F.col("count") == 1)).withColumn("deleted", (F.col(delta) < 0) & (F.col("count") == 0)).drop("sum")
