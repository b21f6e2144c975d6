"""Queries on scalar functions, codecs, templates, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cbor, scalars, templates
from ..sources import files, tables
from .registry import ORACLE_SQL, QUERIES, query
from .tables import BUCKET

HEX32 = "printf('%08x', {x})"


@query("time_ordered_ids", "messages", " SELECT event_id, substr(printf('%012x', ts_ms), 1, 8) || '-' || substr(printf('%012x', ts_ms), 9, 4) || '-7' AS head, 36 AS chars, true AS same_ms, true AS valid, true AS parsed FROM messages")
def time_ordered_ids(read, spark):
    """Time-ordered ids with what they hold."""
    u = scalars.uuid7(F.col("ts_ms"), F.col("event_id"))
    m = read("messages").select("event_id", "ts_ms", u.alias("id"))
    return m.select("event_id", F.substring("id", 1, 15).alias("head"), F.char_length("id").alias("chars"), (scalars.uuid_text(scalars.uuid_bytes(F.upper("id"))) == F.col("id")).alias("parsed"), (scalars.uuid7_ms(F.col("id")) == F.col("ts_ms")).alias("same_ms"), scalars.uuid7_valid(F.col("id")).alias("valid"))


@query("backoff_delays", "messages", ", a AS (SELECT event_id, event_id % 12 + 1 AS attempt, CAST(event_id % 100 AS DOUBLE) / 100 AS draw FROM messages) SELECT event_id, greatest(50, CAST(floor(draw * least(30000.0::DOUBLE, 100 * pow(2.0::DOUBLE, attempt - 1))) AS BIGINT)) AS delay, least(100 * attempt * 2, 1500) AS doubled FROM a")
def backoff_delays(read, spark):
    attempt = F.col("event_id") % 12 + 1
    draw = (F.col("event_id") % 100).cast("double") / 100
    return read("messages").select("event_id", scalars.backoff(attempt, 100, 30000, 50, draw).alias("delay"), F.least(100 * attempt * 2, F.lit(1500)).alias("doubled"))


@query("feature_masks", "entries", " SELECT entry_id, (CASE WHEN entry_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN entry_id % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN entry_id % 5 = 0 THEN 32 ELSE 0 END) AS mask, ((CASE WHEN entry_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN entry_id % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN entry_id % 5 = 0 THEN 32 ELSE 0 END)) & 34 AS common, entry_id % 5 = 0 AS identifies FROM entries")
def feature_masks(read, spark):
    """Capabilities as a mask, in common with another, and read back."""
    flags = F.create_map(F.lit("shared_registration"), F.col("entry_id") % 2 == 0, F.lit("pattern_based_registration"), F.col("entry_id") % 3 == 0, F.lit("caller_identification"), F.col("entry_id") % 5 == 0)
    m = read("entries").select("entry_id", scalars.mask(flags).cast("long").alias("mask"))
    return m.select("entry_id", "mask", F.col("mask").bitwiseAND(F.lit(34)).alias("common"), scalars.unmasked(F.col("mask"))["caller_identification"].alias("identifies"))


@query("mask_aggregates", "entries", " SELECT realm, bit_and(session % 16 + 16) AS common, bit_or(session % 16) AS combined FROM entries GROUP BY realm")
def mask_aggregates(read, spark):
    return read("entries").groupBy("realm").agg(F.bit_and(F.col("session") % 16 + 16).alias("common"), F.bit_or(F.col("session") % 16).alias("combined"))


STATUSES = "statuses AS (SELECT unnest([200, 400, 401, 403, 404, 408, 418, 422, 429, 500, 502, 503, 504]) AS status)"


@query("status_errors", "", f"""WITH {STATUSES} SELECT status, CASE WHEN status IN (400, 422) THEN 'wamp.error.invalid_argument' WHEN status IN (401, 403) THEN 'wamp.error.not_authorized' WHEN status = 404 THEN 'wamp.error.not_found' WHEN status IN (408, 504) THEN 'wamp.error.timeout'
 WHEN status = 429 THEN 'tramline.error.too_many_requests' WHEN status BETWEEN 400 AND 499 THEN 'tramline.error.invalid_argument' ELSE 'tramline.error.bad_gateway' END AS error, CASE WHEN status IN (400, 422) THEN 400 WHEN status IN (401, 403) THEN 401 WHEN status IN (408, 504) THEN 504 WHEN status = 404 OR status BETWEEN 405 AND 499 THEN 500 ELSE 503 END AS back FROM statuses""")
def status_errors(read, spark):
    """HTTP statuses as errors and back."""
    s = spark.createDataFrame([(x,) for x in (200, 400, 401, 403, 404, 408, 418, 422, 429, 500, 502, 503, 504)], "status int")
    s = s.withColumn("error", scalars.status_error(F.col("status")))
    return s.withColumn("back", scalars.error_status(F.col("error")))


@query("bodies", "messages", " SELECT event_id, concat('k=', json_extract_string(props, '$.k'), '&topic=', topic) AS form, concat('''', event_type, ''' and ''', node, '''') AS listing, concat('event=', event_id, ' note=\"a b\" topic=', topic) AS log FROM messages")
def bodies(read, spark):
    """Form bodies, lists for people, and log lines."""
    k = F.get_json_object("props", "$.k")
    form = scalars.form_body(F.create_map(F.lit("topic"), "topic", F.lit("k"), k))
    log = files.log_line(F.create_map(F.lit("topic"), "topic", F.lit("event"), F.col("event_id").cast("string"), F.lit("note"), F.lit("a b")))
    return read("messages").select("event_id", form.alias("form"), scalars.joined(F.array("event_type", "node")).alias("listing"), log.alias("log"))


CONTEXT = "concat('{\"event\":{\"topic\":\"', topic, '\",\"id\":', event_id, '},\"codes\":{\"click\":\"201\",\"error\":\"503\"},\"kind\":\"', event_type, '\"}')"


@query("templates", "messages", " SELECT event_id, concat(topic, '/', event_id) AS target, CASE event_type WHEN 'click' THEN '201' WHEN 'error' THEN '503' ELSE '500' END AS status, concat('/api/', session, '/', event_type, '/{{missing}}') AS path FROM messages")
def template_expressions(read, spark):
    """Templates compiled to columns: paths, lookup with a default, cast, and interpolation."""
    m = read("messages").withColumn("context", F.expr(CONTEXT))
    values = F.create_map(F.lit("session"), F.col("session").cast("string"), F.lit("kind"), F.col("event_type"))
    return m.select("event_id", templates.compiled("{{event.topic}}/{{event.id}}", F.col("context")).alias("target"), templates.compiled("{{codes |> get({{kind}}, 500) |> integer}}", F.col("context")).alias("status"), templates.interpolated("/api/{{session}}/{{kind}}/{{missing}}", values).alias("path"))


@query("json_messages", "messages", " SELECT event_id, 'PUBLISH' AS type, topic, props AS payload, json_extract_string(props, '$.k') AS k FROM messages")
def json_messages(read, spark):
    """Messages packed as positional arrays and unpacked again, the payload kept as text until it is read."""
    packed = F.concat(F.lit("[16,"), F.col("event_id").cast("string"), F.lit(',{},"'), "topic", F.lit('",'), F.concat(F.lit("["), "props", F.lit("]")), F.lit("]"))
    m = read("messages").select("event_id", files.unpacked(packed).alias("m"))
    payload = F.get_json_object(F.col("m.fields")["args"], "$[0]")
    return m.select("event_id", F.col("m.type").alias("type"), F.col("m.fields")["topic"].alias("topic"), F.replace(payload, F.lit(":"), F.lit(": ")).alias("payload"), F.get_json_object(payload, "$.k").alias("k"))


@query("cbor_round_trip", "messages", " SELECT event_id, replace(props, ' ', '') AS json, 4 + CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 24 THEN 0 ELSE 1 END AS bytes FROM messages")
def cbor_round_trip(read, spark):
    """JSON payloads as CBOR and back."""
    m = read("messages").select("event_id", cbor.from_json_text("props").alias("b"))
    return m.select("event_id", cbor.to_json_text("b").alias("json"), F.octet_length("b").cast("long").alias("bytes"))


@query("names", "", "SELECT c_custkey, lower(c_name) AS normal, lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS part, substr(c_name, 1, 12) AS cut, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE 'paid' END, 'owes') AS state FROM customer")
def names(read, spark):
    c = read("customer")
    return c.select("c_custkey", scalars.normal_name("c_name").alias("normal"), F.lpad(F.col("c_custkey").cast("string"), 16, "0").alias("part"), F.substring("c_name", 1, 12).alias("cut"), F.coalesce(F.when(F.col("c_acctbal") >= 0, "paid"), F.lit("owes")).alias("state"))


@query("message_partitions", "messages", " SELECT event_id, list_reduce(list_transform(string_split(topic, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a, x) * 16777619 % 4294967296, 2166136261::BIGINT) % 12 AS fnv, ltrim(array_to_string(list_transform(range(7, -1, -1), lambda i: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST((ts_ms // CAST(pow(62, i) AS BIGINT)) % 62 + 1 AS INT), 1)), ''), '0') AS short FROM messages")
def message_partitions(read, spark):
    """Partitions of messages by FNV-1a, and short ids."""
    return read("messages").select("event_id", F.pmod(scalars.fnv1a(F.col("topic")), F.lit(12)).alias("fnv"), scalars.base62(F.col("ts_ms")).alias("short"))


@query("exposition", "messages", " SELECT '# TYPE events_total counter' AS line UNION ALL SELECT concat('events_total{realm=\"', realm, '\",kind=\"', event_type, '\"} ', count(*)) FROM messages GROUP BY realm, event_type")
def exposition(read, spark):
    """Counters in the Prometheus text format."""
    counts = read("messages").groupBy("realm", F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return files.exposition(counts, "events_total", "n", ["realm", "kind"])


@query("references", "entries", " SELECT entry_id, concat('ref:', node, ':client:', session, ':p#', uri) AS reference, node AS node_back, CAST(session AS VARCHAR) AS session_back FROM entries")
def references(read, spark):
    """References as URIs, and read back."""
    r = read("entries").select("entry_id", F.concat_ws(":", F.lit("ref"), "node", F.lit("client"), "session", F.concat(F.lit("p#"), "uri")).alias("reference"))
    parts = F.split("reference", ":", 5)
    return r.select("entry_id", "reference", parts[1].alias("node_back"), parts[3].alias("session_back"))


@query("method_sets", "entries", " SELECT entry_id, array_to_string(list_sort(list_intersect(['get', 'post', 'put'], CASE WHEN entry_id % 2 = 0 THEN ['post', 'delete'] ELSE ['get', 'put'] END)), ',') AS allowed FROM entries")
def method_sets(read, spark):
    declared = F.when(F.col("entry_id") % 2 == 0, F.array(F.lit("post"), F.lit("delete"))).otherwise(F.array(F.lit("get"), F.lit("put")))
    return read("entries").select("entry_id", F.array_join(F.array_sort(F.array_intersect(F.array(F.lit("get"), F.lit("post"), F.lit("put")), declared)), ",").alias("allowed"))


def _stream(spark, sf_dir: str, build):
    """Runs a stream over the events to its end, in a folder that the cluster shares, and reads what it wrote."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="tramline-")
    folder = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts_ms", F.expr(tables.SPARK_MS)).withColumn("ts", F.timestamp_millis("ts_ms"))
    out = build(events)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def stream_token_bucket(spark, sf_dir: str):
    """The token bucket as a stream; the same verdicts as in batch."""
    from ..streaming import stateful

    return _stream(spark, sf_dir, lambda e: stateful.token_bucket(e.withColumnRenamed("user_id", "session"), "session", 3, 1 / 7_200_000))


def stream_windows(spark, sf_dir: str):
    """Closed event-time windows of a day, by type."""
    from ..streaming import stateful

    out = _stream(spark, sf_dir, lambda e: stateful.windowed_counts(e, ["event_type"], "1 day", "1 hour"))
    return out.select(F.expr("unix_millis(window.start) div 86400000").alias("day"), "event_type", "n")


QUERIES["stream_token_bucket"] = stream_token_bucket
QUERIES["stream_windows"] = stream_windows
ORACLE_SQL["stream_token_bucket"] = BUCKET + " SELECT session, ts_ms, allowed, CASE WHEN allowed THEN tokens ELSE 0 END AS remaining FROM b"
ORACLE_SQL["stream_windows"] = "SELECT epoch_us(ts) // 86400000000 AS day, event_type, count(*) AS n FROM events WHERE epoch_us(ts) // 86400000000 < (SELECT (max(epoch_us(ts)) // 1000 - 3600000) // 86400000 FROM events) GROUP BY ALL"
