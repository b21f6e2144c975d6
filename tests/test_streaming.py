"""Streams run to the end of their input and agree with the batch operators."""

import pytest
from pyspark.sql import functions as F

from tramline.operators import state
from tramline.streaming import stateful


def run(stream, mode, tmp_path):
    name = "t" + str(abs(hash(str(tmp_path))))
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name).collect()


@pytest.fixture()
def source(spark, tmp_path):
    def make(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    return make


def test_token_bucket(spark, source, tmp_path):
    rows = [("a", t) for t in (0, 1, 2, 1500, 4000)] + [("b", 5)]
    got = {(r.key, r.ts_ms, r.allowed) for r in run(stateful.token_bucket(source(rows, "key string, ts_ms long"), "key", 2, 1 / 1000), "append", tmp_path)}
    want = {(r.key, r.ts_ms, r.allowed) for r in state.token_bucket(spark.createDataFrame(rows, "key string, ts_ms long"), "key", 2, 1 / 1000, ["ts_ms"]).collect()}
    assert got == want


def test_token_bucket_of_many_frames(spark, source, tmp_path):
    rows = [(k, t) for t in range(9000, 0, -700) for k in ("a", "b")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = sorted(tuple(r) for r in run(stateful.token_bucket(source(rows, "key string, ts_ms long"), "key", 2, 1 / 1000), "append", tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = state.token_bucket(spark.createDataFrame(rows, "key string, ts_ms long"), "key", 2, 1 / 1000, ["ts_ms"]).select("key", "ts_ms", "allowed", "remaining")
    assert got == sorted(tuple(r) for r in want.collect())


def test_queue_and_counts(spark, source, tmp_path):
    got = run(stateful.bounded_queue(source([("q", i, 4, f"m{i}") for i in range(6)], "q string, seq long, size long, message string"), "q", 4, 13), "update", tmp_path)
    assert [(r.held, r.oldest, r.dropped) for r in got] == [(3, 3, 3)]


def test_first_and_last(source, tmp_path):
    got = run(stateful.first_and_last(source([("t", 1, 1), ("t", 2, 1), ("t", 3, -1), ("t", 4, -1), ("t", 5, -1)], "topic string, `order` long, delta long"), ["topic"]), "append", tmp_path)
    assert sorted((r.order, r.event) for r in got) == [(1, "created"), (4, "deleted")]


def test_retained_and_fan_out(spark, source, tmp_path):
    stream = source([("r", "a.b", 1, "x"), ("r", "a.b", 2, "y")], "realm string, topic string, n long, v string")
    last = run(stateful.retained(stream, ["realm", "topic"], "n", ["n", "v"]), "complete", tmp_path)
    assert [(r.topic, r.v) for r in last] == [("a.b", "y")]
    subs = spark.createDataFrame([("r", "a", "prefix", 1), ("r", ".b", "wildcard", 2), ("r", "c", "exact", 3)], "realm string, uri string, policy string, id int")
    got = run(stateful.fan_out(stream, subs), "append", tmp_path / "x")
    assert sorted((r.n, r.id) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_call_outcomes(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.col(s) + 1000)
    spark.createDataFrame([("r", 1, 0), ("r", 2, 0), ("r", 3, 1000)], "realm string, call_id long, s long").withColumn("sent", at("s")).write.parquet(str(tmp_path / "calls"))
    spark.createDataFrame([("r", 1, 5, False), ("r", 2, 50, False), ("r", 3, 1001, True)], "realm string, call_id long, s long, failed boolean").withColumn("at", at("s")).write.parquet(str(tmp_path / "answers"))
    calls = spark.readStream.schema(spark.read.parquet(str(tmp_path / "calls")).schema).parquet(str(tmp_path / "calls")).drop("s")
    answers = spark.readStream.schema(spark.read.parquet(str(tmp_path / "answers")).schema).parquet(str(tmp_path / "answers")).drop("s")
    got = {(r.call_id, r.outcome) for r in run(stateful.call_outcomes(calls, answers, "10 seconds", "1 second"), "append", tmp_path)}
    assert got == {(1, "result"), (2, "timeout"), (3, "error")}


@pytest.fixture()
def timed(spark, tmp_path):
    """A stream that reads its rows batch by batch, one file each; `at` and `until` are seconds."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schema)
            for c in ("at", "until"):
                if c in df.columns:
                    df = df.withColumn(c, F.timestamp_seconds(c))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
        kinds = spark.read.parquet(str(tmp_path / "in")).drop("b").schema
        return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    return make


def test_pending_calls(timed, tmp_path):
    call, end = lambda i, at, until, who="n1": ("r", who, i, at, "call", until), lambda i, at, kind, who="n1": ("r", who, i, at, kind, None)
    first = [call(1, 1, 11), end(1, 3, "result"), call(2, 1, 11), end(2, 4, "skip"), call(3, 2, 11), end(3, 3, "kill"), end(3, 5, "result"), call(4, 2, 9), call(5, 2, 9), end(5, 6, "kill"), call(6, 2, 50, "n2"), call(7, 3, 60, "n2"), end(6, 4, "error", "n2"), end(None, 8, "gone", "n2")]
    later = [call(8, 100, 101, "n3"), end(9, 100, "result", "n3")]
    got = run(stateful.pending_calls(timed([first, later, [call(10, 200, 201, "n4")]], "realm string, callee string, call_id long, at long, kind string, until long"), "1 second"), "append", tmp_path)
    assert {(r.call_id, r.outcome) for r in got} >= {(1, "result"), (2, "canceled"), (3, "canceled"), (4, "timeout"), (5, "canceled"), (6, "error"), (7, "callee_gone"), (8, "timeout")}
    assert len({r.call_id for r in got}) == len(got) and not {9, 10} & {r.call_id for r in got}


def test_queue_with_expiry(timed, tmp_path):
    rows = [("q", i, i, "put") for i in range(1, 7)] + [("q", 0, 7, "drain")]
    got = run(stateful.queue_with_expiry(timed([rows, [("q", 0, 12, "drain")], [("other", 1, 100, "put")], [("other", 2, 200, "put")]], "q string, seq long, at long, kind string"), "q", 10_000, 5, 2, "1 second"), "append", tmp_path)
    assert sorted((r.q, r.seq, r.fate) for r in got) == [("other", 1, "expired"), ("q", 1, "dropped"), ("q", 2, "sent"), ("q", 3, "sent"), ("q", 4, "sent"), ("q", 5, "sent"), ("q", 6, "expired")]


def test_retained_until(timed, tmp_path):
    stream = timed([[("a", 1, 5, "old"), ("a", 2, 6, "new"), ("b", 1, None, "kept")], [("c", 100, None, "x")], [("c", 200, None, "y")]], "topic string, at long, until long, v string")
    got = run(stateful.retained_until(stream, ["topic"], "at", "until", "v", "1 second"), "update", tmp_path)
    assert {(r.topic, r.value, r.evicted) for r in got} == {("a", "new", False), ("a", "new", True), ("b", "kept", False), ("c", "x", False), ("c", "y", False)}
