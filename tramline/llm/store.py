"""Tables written in the folder that the cluster shares, to cut lineage and to survive lost executors; joins with hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch while a table is written: few, since a row may be a whole text or a packed block.
ROWS = 1000
#: Rows under one key from which it may count as hot, and hot keys that are broadcast at most (16 bytes each).
HOT, MOST_HOT = 64, 50_000

#: Folder of each application whose session names none, and tables written and not yet deleted.
_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str, str]] = []
_owner = [""]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, but only if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if app not in _own:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tramline-")
        folder = _own[app]
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back; batches for Python are small meanwhile."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = f"{shared_folder(spark)}/tramline-{what}-{uuid.uuid4().hex}", spark.conf.get(key)
    _made.append((spark, path, _owner[-1]))
    spark.conf.set(key, str(min(ROWS, int(before)) if int(before) > 0 else ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables there are, for `discard`."""
    return len(_made)


@contextmanager
def owned(owner: str):
    """Tables written meanwhile have this owner."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def discard(since: int = 0, but: DataFrame | None = None, owner: str | None = None) -> None:
    """Deletes the tables (of an owner) written since `made` gave this number, except those that `but` reads. What is lazy
    must not need them."""
    stay = set(but.inputFiles()) if but is not None else set()
    folders = {x.rsplit("/", 1)[0].split("/tramline-")[-1] for x in stay}
    for item in _made[since:]:
        spark, path, whose = item
        if owner in (None, whose) and path.split("/tramline-")[-1] not in folders:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _made.remove(item)


@atexit.register
def _leave() -> None:
    """What no result needs any more goes with the process; a session that is gone already keeps its tables."""
    try:
        discard()
    except Exception:  # noqa: BLE001 the gateway may be closed
        pass


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` joined with `table`, which has one row for each key and counts the key's rows in `count` (dropped).

    Keys with more than HOT rows, the commonest MOST_HOT at most, are broadcast with their row of the table, so their rows
    stay where they are; all others are shuffled. How many rows a broadcast key has at least comes from a histogram of 64
    numbers.
    """
    octaves = table.groupBy(F.floor(F.log2(count)).cast("int").alias("octave")).count().collect()
    least, held = 1 << 62, 0
    for r in sorted(octaves, key=lambda r: -r["octave"]):
        held += r["count"]
        if held > MOST_HOT or 1 << r["octave"] < HOT:
            break
        least = 1 << r["octave"]
    if least == 1 << 62:
        return rows.join(table.drop(count), key)
    hot = F.broadcast(table.where(F.col(count) >= least).drop(count))
    cold = table.where(F.col(count) < least).drop(count)
    names = [*rows.columns, *(c for c in cold.columns if c != key)]
    calm = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).select(*names).unionByName(calm.join(cold, key).select(*names))
