"""Queries on keyed tables, sessions, retained events, calls, queues and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import uri as U
from ..operators import registry as R
from ..operators import state as S
from .registry import query

LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS place FROM changes) x WHERE place = 1 AND NOT deleted)"


@query("lww_view", "changes", f", {LATEST} SELECT k, version, v, node FROM latest")
def lww_view(read, spark):
    """Keyed table of a change log: last writer wins, tombstones hidden (upsert, remove, merge)."""
    return R.latest(read("changes"), ["k"], ["version"]).select("k", "version", "v", "node")


@query("table_scan", "entries", " SELECT realm, policy, count(*) AS entries, sum(length(uri)) AS chars, min(created_ms) AS oldest FROM entries GROUP BY ALL")
def table_scan(read, spark):
    """Fold over a table by realm."""
    return read("entries").groupBy("realm", "policy").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.char_length("uri")).alias("chars"), F.min("created_ms").alias("oldest"))


@query("key_pattern_scan", "entries", " SELECT entry_id, uri FROM entries WHERE realm = 'realm1' AND session = 12")
def key_pattern_scan(read, spark):
    """Rows whose key unifies with a partial key."""
    return R.find(read("entries"), realm="realm1", session=12, entry_id=None).select("entry_id", "uri")


@query("point_lookup", "entries", " SELECT entry_id, realm, uri FROM entries WHERE realm = 'realm0' AND entry_id = 21")
def point_lookup(read, spark):
    return R.find(read("entries"), realm="realm0", entry_id=21, limit=1).select("entry_id", "realm", "uri")


@query("page_after", "entries", " SELECT realm, uri, entry_id FROM entries WHERE (realm, uri, entry_id) > ('realm1', 'com.app.click.u3', 23) ORDER BY ALL LIMIT 100")
def page_after(read, spark):
    """The page after a cursor, by key."""
    return R.page(read("entries").select("realm", "uri", "entry_id"), ["realm", "uri", "entry_id"], 100, ("realm1", "com.app.click.u3", 23))


@query("destructive_take", "entries", " SELECT (SELECT count(*) FROM entries WHERE session = 5) AS taken, (SELECT count(*) FROM entries WHERE session <> 5) AS remaining")
def destructive_take(read, spark):
    taken, left = R.take(read("entries"), read("entries").where("session = 5"), ["entry_id"])
    return taken.agg(F.count(F.lit(1)).alias("taken")).crossJoin(left.agg(F.count(F.lit(1)).alias("remaining")))  # one row each


@query("index_to_base", "entries", " SELECT e.entry_id, e.realm, e.invoke FROM (SELECT entry_id * 2 AS id FROM entries WHERE policy = 'wildcard') i JOIN entries e ON e.entry_id = i.id")
def index_to_base(read, spark):
    """Full entries of index rows; rows that are gone are dropped."""
    return read("entries").where("policy = 'wildcard'").select((F.col("entry_id") * 2).alias("id")).join(read("entries"), F.col("id") == F.col("entry_id")).select("entry_id", "realm", "invoke")


@query("node_index", "entries", " SELECT realm, entry_id FROM entries WHERE node = 'node2'")
def node_index(read, spark):
    return R.find(read("entries"), node="node2").select("realm", "entry_id")


@query("sessions_by_example", "messages", ", s AS (SELECT realm, session, node, min(ts_ms) AS opened, count(*) AS events FROM messages GROUP BY ALL) SELECT session, opened, events FROM s WHERE realm = 'realm2' AND node IN ('node1', 'node2') AND NOT session = 5")
def sessions_by_example(read, spark):
    s = read("messages").groupBy("realm", "session", "node").agg(F.min("ts_ms").alias("opened"), F.count(F.lit(1)).alias("events"))
    return R.find(s, exclude={"session": 5}, realm="realm2", node=["node1", "node2"]).select("session", "opened", "events")


@query("session_count", "messages", " SELECT count(DISTINCT session) AS sessions FROM messages")
def session_count(read, spark):
    return read("messages").select("session").distinct().agg(F.count(F.lit(1)).alias("sessions"))


@query("session_sequence", "messages", " SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS seq, lpad(CAST(session AS VARCHAR), 16, '0') AS part FROM messages")
def session_sequence(read, spark):
    w = Window.partitionBy("session").orderBy("ts_ms", "event_id")
    return read("messages").select("event_id", F.row_number().over(w).cast("long").alias("seq"), F.lpad(F.col("session").cast("string"), 16, "0").alias("part"))


@query("flush_closed_sessions", "entries messages", ", closed AS (SELECT DISTINCT session FROM messages WHERE event_type = 'error' AND value > 60) SELECT realm, count(*) AS remaining FROM entries WHERE session NOT IN (SELECT session FROM closed) GROUP BY realm")
def flush_closed_sessions(read, spark):
    closed = read("messages").where("event_type = 'error' and value > 60").select("session")
    return R.without(read("entries"), closed, ["session"]).groupBy("realm").agg(F.count(F.lit(1)).alias("remaining"))


@query("prune_dead_nodes", "entries", " SELECT node, count(*) AS remaining FROM entries WHERE node NOT IN ('node1', 'node3') GROUP BY node")
def prune_dead_nodes(read, spark):
    return R.without(read("entries"), spark.createDataFrame([("node1",), ("node3",)], "node string"), ["node"]).groupBy("node").agg(F.count(F.lit(1)).alias("remaining"))


@query("first_and_last_subscriber", "messages", """, log AS (SELECT event_id, realm, topic, CASE WHEN event_type IN ('error', 'click') AND row_number() OVER w % 2 = 0 THEN -1 ELSE 1 END AS delta FROM messages WINDOW w AS (PARTITION BY realm, topic ORDER BY event_id)),
 s AS (SELECT *, sum(delta) OVER (PARTITION BY realm, topic ORDER BY event_id) AS c FROM log) SELECT event_id, CAST(c AS BIGINT) AS n, delta > 0 AND c = 1 AS created, delta < 0 AND c = 0 AS deleted FROM s""")
def first_and_last_subscriber(read, spark):
    """Running counts of (realm, topic), and the changes that create or delete a topic."""
    w = Window.partitionBy("realm", "topic").orderBy("event_id")
    log = read("messages").withColumn("delta", F.when(F.col("event_type").isin("error", "click") & (F.row_number().over(w) % 2 == 0), -1).otherwise(1))
    return R.first_and_last(log, ["realm", "topic"], ["event_id"]).select("event_id", F.col("count").alias("n"), "created", "deleted")


RETAINED = "retained AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY realm, topic ORDER BY ts_ms DESC, event_id DESC) AS place FROM messages) x WHERE place = 1)"
VALID = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE ts_ms + 86400000 * (event_id % 30) END"
NOW = 1706000000000
#: The fold of a token bucket, request by request.
BUCKET = """WITH RECURSIVE m AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS ts_ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
 b AS (SELECT session, ts_ms, event_id, place, true AS allowed, CAST(2 AS BIGINT) AS tokens, ts_ms AS since FROM m WHERE place = 1 UNION ALL
 SELECT session, ts_ms, event_id, place, whole >= 1, CASE WHEN whole >= 1 THEN whole - 1 ELSE tokens END, CASE WHEN whole >= 1 THEN ts_ms ELSE since END FROM
 (SELECT m.*, b.tokens, b.since, CAST(trunc(least(3.0::DOUBLE, b.tokens + CAST(m.ts_ms - b.since AS DOUBLE) * (1.0::DOUBLE / 7200000.0::DOUBLE))) AS BIGINT) AS whole FROM b JOIN m ON m.session = b.session AND m.place = b.place + 1) x)"""


def kept(read):
    return S.retained(read("messages"), ["realm", "topic"], ["ts_ms", "event_id"]).withColumn("valid_to", F.expr(VALID))


@query("retained_latest", "messages", f", {RETAINED} SELECT realm, topic, event_id, value FROM retained")
def retained_latest(read, spark):
    return kept(read).select("realm", "topic", "event_id", "value")


@query("retained_live", "messages", f", {RETAINED} SELECT realm, topic, event_id FROM retained WHERE NOT ({VALID} > 0 AND {VALID} <= {NOW})")
def retained_live(read, spark):
    return kept(read).where(S.live(F.col("valid_to"), NOW)).select("realm", "topic", "event_id")


@query("retained_evicted", "messages", f", {RETAINED} SELECT realm, count(*) AS evicted FROM retained WHERE {VALID} > 0 AND {VALID} <= {NOW} GROUP BY realm")
def retained_evicted(read, spark):
    return kept(read).where(~S.live(F.col("valid_to"), NOW)).groupBy("realm").agg(F.count(F.lit(1)).alias("evicted"))


@query("retained_eligibility", "messages", f", {RETAINED}, o AS (SELECT realm, topic, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE [7, 8, 9] END AS elig, CASE WHEN event_id % 2 = 0 THEN [8] ELSE [] END AS excl FROM retained) SELECT realm, topic, (elig IS NULL OR list_contains(elig, 8)) AND NOT list_contains(excl, 8) AS served FROM o")
def retained_eligibility(read, spark):
    """Whether session 8 is served: an empty list of eligible sessions means nobody here."""
    empty = F.expr("cast(array() as array<int>)")
    elig = F.when(F.col("event_id") % 3 == 1, empty).when(F.col("event_id") % 3 == 2, F.array(F.lit(7), F.lit(8), F.lit(9)))
    excl = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(8))).otherwise(empty)
    return kept(read).select("realm", "topic", S.deliverable(F.lit(8), elig, excl, nobody_if_empty=True).alias("served"))


@query("retained_prefix_page", "messages", f", {RETAINED} SELECT realm, topic FROM retained WHERE starts_with(topic, 'com.app.click') ORDER BY topic, realm LIMIT 100")
def retained_prefix_page(read, spark):
    return R.page(kept(read).where(F.startswith("topic", F.lit("com.app.click"))).select("realm", "topic"), ["topic", "realm"], 100)


@query("retained_wildcard_page", "messages", f", {RETAINED} SELECT realm, topic FROM retained WHERE len(string_split(topic, '.')) = 4 AND string_split(topic, '.')[1] = 'com' AND string_split(topic, '.')[4] = 'u7' ORDER BY topic, realm LIMIT 100")
def retained_wildcard_page(read, spark):
    return R.page(kept(read).where(U.matches(F.col("topic"), F.lit("com...u7"), F.lit("wildcard"))).select("realm", "topic"), ["topic", "realm"], 100)


@query("retained_replay", "messages entries", f", {RETAINED}, subs AS (SELECT * FROM entries WHERE policy = 'prefix' AND entry_id % 5 = 0) SELECT r.event_id, s.entry_id AS subscription, true AS retained FROM subs s JOIN retained r ON r.realm = s.realm AND starts_with(r.topic, s.uri)")
def retained_replay(read, spark):
    """Retained events that new subscriptions get at once."""
    from ..operators import patterns as P

    subs = read("entries").where("policy = 'prefix' and entry_id % 5 = 0").select("realm", "uri", "policy", F.col("entry_id").alias("subscription"))
    return P.match_patterns(kept(read).select("realm", "topic", "event_id"), subs, policies=("prefix",)).select("event_id", "subscription", F.lit(True).alias("retained"))


@query("retained_counters", "messages", f", {RETAINED} SELECT realm, count(*) AS messages, sum(length(props)) AS memory, sum(CASE WHEN run <= 4000 THEN 1 ELSE 0 END) AS within_limit FROM (SELECT *, sum(length(props)) OVER (PARTITION BY realm ORDER BY ts_ms, event_id) AS run FROM retained) x GROUP BY realm")
def retained_counters(read, spark):
    """Messages and bytes of each realm, and how many came before its memory was full."""
    run = R.running(kept(read), ["realm"], [(F.expr("ts_ms div 3600000"), False)], [F.col("ts_ms"), F.col("event_id")], F.octet_length("props"), "run")
    return run.groupBy("realm").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("props")).alias("memory"), F.sum(F.when(F.col("run") <= 4000, 1).otherwise(0)).alias("within_limit"))


OUTCOMES = """first AS (SELECT realm, call_id, min(at_ms) AS at_ms FROM responses GROUP BY ALL), r AS (SELECT r.realm, r.call_id, r.at_ms, bool_or(failed) AND min(failed::INT) = 1 AS failed FROM responses r JOIN first f ON r.realm = f.realm AND r.call_id = f.call_id AND r.at_ms = f.at_ms GROUP BY ALL),
 done AS (SELECT c.*, CASE WHEN r.at_ms <= sent_ms + timeout_ms AND failed THEN 'error' WHEN r.at_ms <= sent_ms + timeout_ms THEN 'result' ELSE 'timeout' END AS outcome, CASE WHEN r.at_ms <= sent_ms + timeout_ms THEN r.at_ms ELSE sent_ms + timeout_ms END AS done_ms FROM calls c LEFT JOIN r ON r.realm = c.realm AND r.call_id = c.call_id)"""


@query("call_outcomes", "calls responses", f", {OUTCOMES} SELECT call_id, outcome, done_ms FROM done")
def call_outcomes(read, spark):
    """Calls with their result, error or timeout."""
    return S.correlate(read("calls"), read("responses")).select("call_id", "outcome", "done_ms")


@query("pending_calls", "calls responses", f", {OUTCOMES} SELECT realm, callee, sum(CASE WHEN sent_ms + timeout_ms >= 500 THEN 1 ELSE 0 END) AS active, sum(CASE WHEN sent_ms + timeout_ms < 500 THEN 1 ELSE 0 END) AS expired, count(*) AS every FROM done WHERE sent_ms <= 500 AND done_ms > 450 GROUP BY ALL")
def pending_calls(read, spark):
    """Active and expired promises by realm and callee, at a time."""
    d = S.correlate(read("calls"), read("responses")).where("sent_ms <= 500 and done_ms > 450")
    live = F.col("expiry_ms") >= 500
    return d.groupBy("realm", "callee").agg(F.sum(F.when(live, 1).otherwise(0)).alias("active"), F.sum(F.when(~live, 1).otherwise(0)).alias("expired"), F.count(F.lit(1)).alias("every"))


@query("callee_death", "calls responses", f", {OUTCOMES} SELECT call_id, caller, 'callee_gone' AS error FROM done WHERE callee = 'node2' AND sent_ms <= 500 AND done_ms > 500")
def callee_death(read, spark):
    """Calls that fail because their callee goes at a time."""
    d = S.correlate(read("calls"), read("responses"))
    return d.where("callee = 'node2' and sent_ms <= 500 and done_ms > 500").select("call_id", "caller", F.lit("callee_gone").alias("error"))


@query("cancelled_calls", "calls responses", f", {OUTCOMES}, p AS (SELECT * FROM done WHERE sent_ms <= 300 AND done_ms > 300) SELECT call_id, m AS mode, m IN ('skip', 'killnowait') AS caller_answered, m IN ('kill', 'killnowait') AS callee_interrupted, m = 'kill' AS awaits_callee FROM p, (VALUES ('skip'), ('kill'), ('killnowait')) v(m)")
def cancelled_calls(read, spark):
    from functools import reduce

    d = S.correlate(read("calls"), read("responses"))
    return reduce(lambda a, b: a.unionByName(b), [S.cancelled(d, m, F.lit(300)).select("call_id", F.lit(m).alias("mode"), "caller_answered", "callee_interrupted", "awaits_callee") for m in ("skip", "kill", "killnowait")])


@query("call_deadlines", "calls", " SELECT call_id, sent_ms + CASE WHEN call_id % 5 = 0 THEN 3600 WHEN call_id % 5 = 1 THEN 30 ELSE timeout_ms END AS deadline FROM calls")
def call_deadlines(read, spark):
    """A timeout of 0 is the greatest allowed, a missing one the default."""
    asked = F.when(F.col("call_id") % 5 == 0, 0).when(F.col("call_id") % 5 != 1, F.col("timeout_ms"))
    return read("calls").select("call_id", (F.col("sent_ms") + F.when(asked == 0, 3600).otherwise(F.coalesce(asked, F.lit(30)))).alias("deadline"))


@query("token_bucket", "", BUCKET + " SELECT session, ts_ms, event_id, allowed, CASE WHEN allowed THEN tokens ELSE 0 END AS remaining, CASE WHEN allowed AND tokens >= 1 THEN 0 ELSE CAST(ceil(1.0::DOUBLE / (1.0::DOUBLE / 7200000.0::DOUBLE)) AS BIGINT) END AS resets_in_ms FROM b")
def token_bucket(read, spark):
    """A bucket of three tokens for each user, one more every two hours."""
    m = read("messages").select("session", "ts_ms", "event_id")
    return S.token_bucket(m, "session", 3, 1 / 7_200_000, ["ts_ms", "event_id"])


@query("bounded_queue", "messages", ", q AS (SELECT *, count(*) OVER w AS behind, sum(length(topic)) OVER w AS bytes FROM messages WINDOW w AS (PARTITION BY session ORDER BY event_id DESC)) SELECT session, count(*) AS held, min(event_id) AS oldest FROM q WHERE behind <= 50 AND bytes <= 900 GROUP BY session")
def bounded_queue(read, spark):
    q = S.bounded_queue(read("messages").withColumn("size", F.octet_length("topic")), "session", "event_id", "size", 50, 900)
    return q.groupBy("session").agg(F.count(F.lit(1)).alias("held"), F.min("event_id").alias("oldest"))


@query("queue_drain", "messages", f", q AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_id) AS place FROM messages WHERE ts_ms + 864000000 > {NOW}) SELECT session, event_id, place FROM q WHERE place <= 10")
def queue_drain(read, spark):
    return S.drained(read("messages"), "session", "event_id", "ts_ms", 864_000_000, NOW, 10).select("session", "event_id", F.col("place").cast("long").alias("place"))


@query("expiry_rules", "messages", f" SELECT event_id, ts_ms <= {NOW} + 1000 AS ticket_expired, ts_ms + 86400000 + 1000 <= {NOW} AS token_expired FROM messages")
def expiry_rules(read, spark):
    """Tickets are lenient before, tokens after their time."""
    return read("messages").select("event_id", (F.col("ts_ms") <= NOW + 1000).alias("ticket_expired"), (F.col("ts_ms") + 86_400_000 + 1000 <= NOW).alias("token_expired"))


@query("newest_tokens", "messages", " SELECT session, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_ms DESC, event_id DESC) AS place FROM messages) x WHERE place <= 3")
def newest_tokens(read, spark):
    """The three tokens that expire last of each user; Spark limits groups before the shuffle."""
    w = Window.partitionBy("session").orderBy(F.desc("ts_ms"), F.desc("event_id"))
    return read("messages").withColumn("place", F.row_number().over(w)).where("place <= 3").select("session", "event_id")


@query("token_set_merge", "messages", ", a AS (SELECT session % 40 AS k, max(event_id) AS v FROM messages WHERE session % 3 = 0 GROUP BY 1), b AS (SELECT session % 40 AS k, min(event_id) AS v FROM messages WHERE session % 2 = 0 GROUP BY 1) SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def token_set_merge(read, spark):
    """Two maps merged, the right one wins."""
    m = read("messages").withColumn("k", F.col("session") % 40)
    a = m.where("session % 3 = 0").groupBy("k").agg(F.max("event_id").alias("old"))
    b = m.where("session % 2 = 0").groupBy("k").agg(F.min("event_id").alias("new"))
    return a.join(b, "k", "full").select("k", F.coalesce("new", "old").alias("v"))


@query("event_counters", "messages", " SELECT realm, event_type, node, count(*) AS total, sum(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS gauge FROM messages GROUP BY ALL")
def event_counters(read, spark):
    gauge = F.sum(F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0))
    return read("messages").groupBy("realm", "event_type", "node").agg(F.count(F.lit(1)).alias("total"), gauge.alias("gauge"))


# Boundaries of histograms (fixed values).
MILLISECONDS = [0, 1, 2, 5, 10, 15, 25, 50, 75, 100, 150, 200, 250, 300, 400, 500, 750, 1000, 1500, 2000, 2500, 3000, 4000, 5000]


@query("value_histogram", "messages", f" SELECT event_type, le, sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS n FROM messages, (SELECT unnest({MILLISECONDS}) AS le) b GROUP BY ALL")
def value_histogram(read, spark):
    """Cumulative buckets: one pass that sums a column for each boundary, then 24 rows for each type."""
    sums = read("messages").groupBy("event_type").agg(*(F.sum(F.when(F.col("value") <= le, 1).otherwise(0)).alias(f"b{le}") for le in MILLISECONDS))
    return sums.select("event_type", F.explode(F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"b{le}").alias("n")) for le in MILLISECONDS))).alias("b")).select("event_type", "b.le", "b.n")


@query("http_metrics", "messages", " SELECT CASE WHEN session % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat(CAST(2 + session % 4 AS VARCHAR), 'xx') AS status_class, count(*) AS requests, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS duration FROM messages GROUP BY ALL")
def http_metrics(read, spark):
    m = read("messages").withColumn("method", F.when(F.col("session") % 2 == 0, "GET").otherwise("POST")).withColumn("status_class", F.concat((2 + F.col("session") % 4).cast("string"), F.lit("xx")))
    return m.groupBy("method", "status_class").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("duration"))


@query("policy_summary", "entries", ", p AS (SELECT * FROM (VALUES ('exact'), ('prefix'), ('wildcard'), ('regex')) v(policy)) SELECT p.policy, count(entry_id) AS n, coalesce(string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY entry_id), '') AS ids FROM p LEFT JOIN (SELECT * FROM entries WHERE session = 3) e ON e.policy = p.policy GROUP BY p.policy")
def policy_summary(read, spark):
    """Ids by policy; policies without entries are listed too."""
    p = spark.createDataFrame([("exact",), ("prefix",), ("wildcard",), ("regex",)], "policy string")
    ids = read("entries").where("session = 3").groupBy("policy").agg(F.sort_array(F.collect_list("entry_id")).alias("ids"))
    return p.join(ids, "policy", "left").select("policy", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), F.lit("")).alias("ids"))


@query("grouped_lists", "messages", " SELECT session, string_agg(event_type, ',' ORDER BY event_id) AS kinds, count(*) AS n FROM messages WHERE value > 60 GROUP BY session")
def grouped_lists(read, spark):
    """Rows grouped into lists, in the order of the input."""
    g = read("messages").where("value > 60").groupBy("session").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("rows"))
    return g.select("session", F.array_join("rows.event_type", ",").alias("kinds"), F.size("rows").cast("long").alias("n"))


@query("registry_info", "entries", " SELECT count(*) AS size, sum(length(uri)) AS memory, max(length(uri)) AS longest_uri, max(length(invoke)) AS longest_invoke, coalesce(min(CASE WHEN entry_id < 0 THEN created_ms END), 9223372036854775807) AS min_active FROM entries")
def registry_info(read, spark):
    no_limit = F.lit(2**63 - 1).cast("long")
    return read("entries").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("uri")).alias("memory"), F.max(F.char_length("uri")).alias("longest_uri"), F.max(F.char_length("invoke")).alias("longest_invoke"), F.coalesce(F.min(F.when(F.col("entry_id") < 0, F.col("created_ms"))), no_limit).alias("min_active"))


@query("dispatch_table", "entries", """, rules AS (SELECT DISTINCT s.scheme, e.node AS host, e.uri FROM entries e, (VALUES ('http'), ('https')) s(scheme) WHERE policy = 'exact' AND entry_id < 300 UNION SELECT scheme, node, uri FROM (SELECT 'http' AS scheme, node, uri FROM entries WHERE policy = 'prefix') x),
 hosts AS (SELECT scheme, host, count(*) AS rules, string_agg(uri, ' ' ORDER BY uri) AS uris FROM rules GROUP BY ALL) SELECT scheme, count(*) AS hosts, CAST(sum(rules) AS BIGINT) AS rules, string_agg(host || ':' || CAST(length(uris) AS VARCHAR), ',' ORDER BY host) AS listing FROM hosts GROUP BY scheme""")
def dispatch_table(read, spark):
    """Rules of hosts of schemes: union, set projection and two summaries. Rules meet the two schemes as an array."""
    e = read("entries")
    both = e.where("policy = 'exact' and entry_id < 300").select(F.explode(F.array(F.lit("http"), F.lit("https"))).alias("scheme"), F.col("node").alias("host"), "uri")
    rules = both.union(e.where("policy = 'prefix'").select(F.lit("http"), "node", "uri")).distinct()
    hosts = rules.groupBy("scheme", "host").agg(F.count(F.lit(1)).alias("rules"), F.array_join(F.sort_array(F.collect_list("uri")), " ").alias("uris"))
    line = F.concat("host", F.lit(":"), F.char_length("uris").cast("string"))
    return hosts.groupBy("scheme").agg(F.count(F.lit(1)).alias("hosts"), F.sum("rules").alias("rules"), F.array_join(F.sort_array(F.collect_list(line)), ",").alias("listing"))


@query("external_entries", "entries", " SELECT entry_id, concat(realm, '/', session, '/', entry_id) AS origin_id, CASE WHEN policy = 'exact' THEN uri ELSE concat(policy, ':', uri) END AS resource, strftime(to_timestamp(created_ms // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS created, node = 'node1' AS is_local FROM entries")
def external_entries(read, spark):
    """What others see of an entry: its proxy id, resource, creation time as ISO text and locality."""
    created = F.date_format(F.timestamp_add("SECOND", F.expr("created_ms div 1000"), F.lit("1970-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    resource = F.when(F.col("policy") == "exact", F.col("uri")).otherwise(F.concat_ws(":", "policy", "uri"))
    return read("entries").select("entry_id", F.concat_ws("/", "realm", "session", "entry_id").alias("origin_id"), resource.alias("resource"), created.alias("created"), (F.col("node") == "node1").alias("is_local"))


@query("counter_updates", "messages", " SELECT session AS k, sum(event_id % 5 - 2) AS v FROM messages GROUP BY 1")
def counter_updates(read, spark):
    return read("messages").groupBy(F.col("session").alias("k")).agg(F.sum(F.col("event_id") % 5 - 2).alias("v"))


@query("backup_merge", "changes", ", a AS (SELECT * FROM changes WHERE version % 3 <> 0), b AS (SELECT * FROM changes WHERE version % 2 = 0), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT (SELECT count(*) FROM b) AS read, (SELECT count(*) FROM b WHERE version NOT IN (SELECT version FROM a)) AS merged, (SELECT count(*) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS place FROM u) x WHERE place = 1 AND NOT deleted) AS live")
def backup_merge(read, spark):
    """Rows of a backup read and merged into a table, and what lives afterwards."""
    c = read("changes")
    a, b = c.where("version % 3 <> 0"), c.where("version % 2 = 0")
    counts = b.join(a.select("version", F.lit(1).alias("had")), "version", "left").agg(F.count(F.lit(1)).alias("read"), F.sum(F.when(F.col("had").isNull(), 1).otherwise(0)).alias("merged"))
    live = R.latest(a.unionByName(b).distinct(), ["k"], ["version"]).agg(F.count(F.lit(1)).alias("live"))
    return counts.crossJoin(live)  # one row each


@query("event_windows", "messages", " SELECT ts_ms // 86400000 AS day, event_type, count(*) AS n FROM messages GROUP BY ALL")
def event_windows(read, spark):
    """Extension: tumbling windows of a day."""
    return read("messages").groupBy(F.expr("ts_ms div 86400000").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("metric_cube", "messages", " SELECT realm, event_type, count(*) AS n FROM messages GROUP BY CUBE (realm, event_type)")
def metric_cube(read, spark):
    """Extension: all groupings of two labels."""
    return read("messages").cube("realm", "event_type").agg(F.count(F.lit(1)).alias("n"))
