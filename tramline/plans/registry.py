"""Where queries are registered, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import tables

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """Registers f(read, spark) as a query, `read(name)` giving a derived or base table. `uses`: derived tables of the SQL."""

    def add(f):
        def run(spark, sf_dir):
            return f(lambda t: tables.table(spark, sf_dir, t) if t in tables.TEXTS else tables.base(spark, sf_dir, t), spark)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            named = ", ".join(f"{t} AS ({tables.TEXTS[t].replace('{ms}', 'epoch_us(ts) // 1000')})" for t in uses.split())
            ORACLE_SQL[name] = (f"WITH RECURSIVE {named} " if named else "") + sql
        return f

    return add
