"""Sources and sinks: backups, declarative specs, exposition text, structured logs, message codecs and retried sinks."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import latest

#: Positional fields of protocol messages by code (fixed values).
MESSAGES = {1: ("HELLO", "realm details"), 2: ("WELCOME", "session details"), 3: ("ABORT", "details reason"), 6: ("GOODBYE", "details reason"), 8: ("ERROR", "type request details error args kwargs"), 16: ("PUBLISH", "request options topic args kwargs"), 17: ("PUBLISHED", "request publication"), 32: ("SUBSCRIBE", "request options topic"), 33: ("SUBSCRIBED", "request subscription"), 34: ("UNSUBSCRIBE", "request subscription"), 35: ("UNSUBSCRIBED", "request"), 36: ("EVENT", "subscription publication details args kwargs"), 48: ("CALL", "request options procedure args kwargs"), 49: ("CANCEL", "request options"), 50: ("RESULT", "request details args kwargs"), 64: ("REGISTER", "request options procedure"), 65: ("REGISTERED", "request registration"), 66: ("UNREGISTER", "request registration"), 67: ("UNREGISTERED", "request"), 68: ("INVOCATION", "request registration details args kwargs"), 69: ("INTERRUPT", "request options"), 70: ("YIELD", "request options args kwargs")}


def unpacked(text: Column) -> Column:
    """A JSON message array as (type, fields: name -> JSON text). Payload stays text until someone reads it."""
    parts = F.from_json(text, "array<string>")  # parsed once; elements that aren't strings stay JSON text
    code = F.try_element_at(parts, F.lit(1)).try_cast("int")
    cases = lambda of: reduce(lambda out, x: (out.when if out is not None else F.when)(code == x[0], of(*x[1])), MESSAGES.items(), None)
    kind, names = cases(lambda name, _: F.lit(name)), F.split(cases(lambda _, fields: F.lit(fields)), " ")
    n = F.least(F.size(names), F.size(parts) - 1)
    fields = F.map_filter(F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(parts, F.lit(2), n)), lambda _, v: v.isNotNull())
    return F.struct(kind.alias("type"), F.when(kind.isNotNull(), fields).alias("fields"))


def packed(kind: str, fields: dict[str, Column]) -> Column:
    """A message as a JSON array: its code, then its fields (JSON text) by position; missing ones behind the last are left off."""
    code, names = next((n, names.split()) for n, (name, names) in MESSAGES.items() if name == kind)
    if unknown := set(fields) - set(names):
        raise ValueError(f"{kind} has no {', '.join(sorted(unknown))}")
    last = max((i + 1 for i, n in enumerate(names) if n in fields), default=0)
    parts = [F.coalesce(fields[n], F.lit("null")) if n in fields else F.lit("null") for n in names[:last]]
    return F.concat(F.lit("["), F.concat_ws(",", F.lit(str(code)), *parts), F.lit("]"))


def exposition(metrics: DataFrame, name: str, value: str, labels: list[str], kind: str = "counter") -> DataFrame:
    """Lines of the Prometheus text format, one for each row, under a head."""
    escaped = [F.concat(F.lit(f'{c}="'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in labels]
    line = F.concat(F.lit(name + "{"), F.concat_ws(",", *escaped), F.lit("} "), F.col(value).cast("string"))
    head = metrics.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], "line string")
    return head.unionByName(metrics.select(line.alias("line")))


def log_line(fields: Column, longest: int = 200) -> Column:
    """key=value text of a map, in key order; values with spaces or quotes are quoted, long ones cut."""
    def one(e):
        v = F.coalesce(e["value"], F.lit("null"))
        v = F.when(F.char_length(v) > longest, F.concat(F.substring(v, 1, longest), F.lit("..."))).otherwise(v)
        return F.concat(e["key"], F.lit("="), F.when(F.rlike(v, F.lit('[ "=]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(v))

    return F.array_join(F.array_sort(F.transform(F.map_entries(fields), one)), " ")


def back_up(tables: dict[str, DataFrame], folder: str, skip: tuple[str, ...] = ("registration", "subscription")) -> None:
    """Tables as Parquet under a folder with a head file; registry tables, which live in memory only, are left out."""
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([("tramline-backup", 1, int(time.time() * 1000))], "format string, version int, created_ms long").write.mode("overwrite").json(f"{folder}/head")
    for name, df in tables.items():
        if name not in skip:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def backup_head(spark: SparkSession, folder: str) -> dict:
    head = spark.read.schema("format string, version int, created_ms long").json(f"{folder}/head").first()
    if head is None or head["format"] != "tramline-backup" or head["version"] != 1:
        raise ValueError("not a backup of a known version")
    return head.asDict()


def restore(spark: SparkSession, folder: str, name: str, current: DataFrame, key: list[str], version: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table after merging a backup (last writer wins), and the counts of rows read and merged."""
    backup_head(spark, folder)
    saved = spark.read.parquet(f"{folder}/{name}")
    merged = latest(current.unionByName(saved).distinct(), key, version, deleted=None)
    new = saved.join(current, [*key, *version], "left_anti")
    counts = saved.agg(F.count(F.lit(1)).alias("read")).crossJoin(new.agg(F.count(F.lit(1)).alias("merged")))  # one row each
    return merged, counts


def specs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Distinct subscription specs of a JSON file; those without an id or a topic are dropped."""
    return spark.read.schema(schema).json(path, multiLine=True).where("id is not null and topic is not null").dropDuplicates()


def retried(f: Callable, most: int = 3, delay_s: float = 0.05, cap_s: float = 2.0, sleep: Callable = time.sleep) -> Callable:
    """A sink for foreachBatch that tries again after a doubling, capped delay."""

    def run(df: DataFrame, batch: int):
        wait = delay_s
        for attempt in range(most + 1):
            try:
                return f(df, batch)
            except Exception:
                if attempt == most:
                    raise
                sleep(wait)
                wait = min(wait * 2, cap_s)

    return run


def kafka(df: DataFrame, servers: str, topic: str, key: str, value: str, checkpoint: str, acks: str = "all"):
    """Streaming sink to Kafka; needs Spark's Kafka connector on the class path."""
    out = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", acks).option("topic", topic).option("checkpointLocation", checkpoint)


def posted(send: Callable[[list[dict]], None], size: int = 100) -> Callable:
    """A sink for foreachBatch that hands each partition's rows to a sender (mail, text message, HTTP) in groups."""

    def run(df: DataFrame, batch: int) -> None:
        def each(rows):
            group = []
            for r in rows:
                group.append(r.asDict(recursive=True))
                if len(group) == size:
                    send(group)
                    group = []
            if group:
                send(group)

        df.foreachPartition(each)

    return run
