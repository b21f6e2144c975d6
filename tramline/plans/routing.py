"""Queries on patterns: matching, ranking, load balancing, publishing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import uri as U
from ..operators import balance as B
from ..operators import patterns as P
from ..operators import registry as R
from .registry import query

SPLIT = "string_split({x}, '.')"
MATCH = """CASE e.policy WHEN 'exact' THEN {t} = e.uri WHEN 'prefix' THEN starts_with({t}, e.uri)
 ELSE len(string_split({t}, '.')) = len(string_split(e.uri, '.')) AND
 list_bool_and(list_transform(list_zip(string_split({t}, '.'), string_split(e.uri, '.')), lambda z: (z[2] = '' AND z[1] <> '') OR (z[2] <> '' AND z[1] = z[2]))) END"""
DEGREE = "list_reduce(list_transform(string_split({x}, '.'), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 END), lambda a, x: a * 2 + x, 0)"
TOPICS = "topics AS (SELECT DISTINCT realm, topic FROM messages)"
MATCHED = f"{TOPICS}, matched AS (SELECT t.topic, e.* FROM topics t JOIN entries e ON t.realm = e.realm AND {MATCH.format(t='t.topic')})"
ORDER = f"""CASE policy WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, CASE WHEN policy = 'prefix' THEN uri END DESC,
 CASE WHEN policy = 'wildcard' THEN {DEGREE.format(x='uri')} END DESC, CASE WHEN policy = 'wildcard' THEN uri END,
 CASE WHEN invoke = 'single' THEN 0 ELSE 1 END, invoke, {{node}}created_ms, entry_id"""


def topics(read):
    return read("messages").select("realm", "topic").distinct()


@query("deliveries_per_topic", "messages entries", f", {MATCHED} SELECT m.realm, m.topic, policy, count(*) AS deliveries, count(DISTINCT event_id) AS events FROM messages m JOIN matched USING (realm, topic) GROUP BY ALL")
def deliveries_per_topic(read, spark):
    """Fan-out of publications to matching subscriptions, counted by topic and policy. Patterns meet distinct topics first."""
    matched = P.match_patterns(topics(read), read("entries")).groupBy("realm", "topic", "policy").agg(F.count(F.lit(1)).alias("n"))
    published = read("messages").groupBy("realm", "topic").agg(F.count(F.lit(1)).alias("events"))
    return matched.join(published, ["realm", "topic"]).select("realm", "topic", "policy", (F.col("n") * F.col("events")).alias("deliveries"), "events")


for _policy in P.POLICIES:
    query(f"match_{_policy}", "messages entries", f", {MATCHED} SELECT realm, topic, entry_id, uri FROM matched WHERE policy = '{_policy}'")(
        lambda read, spark, p=_policy: P.match_patterns(topics(read), read("entries"), policies=(p,)).select("realm", "topic", "entry_id", "uri")
    )

query("match_all_policies", "messages entries", f", {MATCHED} SELECT realm, topic, entry_id, policy FROM matched")(lambda read, spark: P.match_patterns(topics(read), read("entries")).select("realm", "topic", "entry_id", "policy"))


@query("direct_match", "entries", " SELECT realm, policy, uri, count(*) AS entries, min(entry_id) AS first_id FROM entries WHERE uri = 'com.app..u31' OR uri = 'com.app.click.u3' GROUP BY ALL")
def direct_match(read, spark):
    """Entries registered under given texts, whatever they would match."""
    return read("entries").where(F.col("uri").isin("com.app..u31", "com.app.click.u3")).groupBy("realm", "policy", "uri").agg(F.count(F.lit(1)).alias("entries"), F.min("entry_id").alias("first_id"))


@query("subsumed_patterns", "entries", """, w AS (SELECT DISTINCT uri FROM entries WHERE policy = 'wildcard') SELECT a.uri AS pattern, b.uri AS other FROM w a JOIN w b ON len(string_split(a.uri, '.')) = len(string_split(b.uri, '.'))
 AND list_bool_and(list_transform(list_zip(string_split(a.uri, '.'), string_split(b.uri, '.')), lambda z: z[1] = '' OR z[1] = z[2]))""")
def subsumed_patterns(read, spark):
    """Pairs of wildcards of which the first holds all that the second matches: blanked by each mask in use, an equi join."""
    w = read("entries").where("policy = 'wildcard'").select("uri").distinct().withColumn("n", F.size(U.components(F.col("uri")))).withColumn("mask", U.shape(F.col("uri")))
    shapes = w.select("n", F.col("mask").alias("of")).distinct()
    other = w.select(F.col("uri").alias("other"), "n").join(shapes, "n").withColumn("key", F.expr("array_join(transform(split(other, '[.]', -1), (x, i) -> if(substring(of, i + 1, 1) = '1', x, '')), '.')")).drop("n")
    return w.join(other, (F.col("uri") == F.col("key")) & (F.col("mask") == F.col("of"))).select(F.col("uri").alias("pattern"), "other")


@query("best_registration", "messages entries", f", {MATCHED} SELECT realm, topic, entry_id, policy FROM (SELECT *, row_number() OVER (PARTITION BY realm, topic ORDER BY {ORDER.format(node='')}) AS place FROM matched) x WHERE place = 1")
def best_registration(read, spark):
    """The registration that a call to each procedure reaches."""
    return P.best_match(P.match_patterns(topics(read), P.best_entries(read("entries"))), ["realm", "topic"]).select("realm", "topic", "entry_id", "policy")


@query("best_local_registration", "messages entries", f""", {MATCHED} SELECT realm, topic, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY realm, topic ORDER BY {ORDER.format(node="CASE WHEN node = 'node1' THEN 0 ELSE 1 END, ")}) AS place FROM matched) x WHERE place = 1""")
def best_local_registration(read, spark):
    """The same, this node's callees first among equals."""
    return P.best_match(P.match_patterns(topics(read), P.best_entries(read("entries"), "node1")), ["realm", "topic"], "node1").select("realm", "topic", "entry_id")


@query("ranked_registry", "entries", f" SELECT realm, entry_id, row_number() OVER (PARTITION BY realm ORDER BY {ORDER.format(node='')}) AS place FROM entries")
def ranked_registry(read, spark):
    """All registrations of a realm, best first."""
    coarse = [*P.ranking_pairs()[:-2], (F.expr("created_ms div 1000"), False)]
    return R.running(read("entries"), ["realm"], coarse, [F.col("created_ms"), F.col("entry_id")]).select("realm", "entry_id", "place")


@query("wildcard_degree", "entries", f" SELECT uri, {DEGREE.format(x='uri')} AS degree, count(*) AS n FROM entries GROUP BY uri")
def wildcard_degree(read, spark):
    return read("entries").groupBy("uri").agg(F.count(F.lit(1)).alias("n")).withColumn("degree", U.degree(F.col("uri")))


@query("limited_matches", "messages entries", f", {MATCHED} SELECT realm, topic, entry_id, place FROM (SELECT realm, topic, entry_id, row_number() OVER (PARTITION BY realm, topic ORDER BY CASE policy WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, entry_id) AS place FROM matched) x WHERE place <= 3")
def limited_matches(read, spark):
    """The first three matches of each topic, policy by policy."""
    w = Window.partitionBy("realm", "topic").orderBy(F.when(F.col("policy") == "exact", 0).when(F.col("policy") == "prefix", 1).otherwise(2), "entry_id")
    return P.match_patterns(topics(read), read("entries")).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("realm", "topic", "entry_id", "place")


@query("load_balancing", "messages entries", f""", {TOPICS}, callees AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY created_ms, entry_id) AS place FROM entries WHERE policy = 'prefix' WINDOW w AS (PARTITION BY realm, uri)),
 calls AS (SELECT event_id, realm, 'com.app.' || event_type || '.u' || (session % 10) AS uri, row_number() OVER (PARTITION BY realm, event_type, session % 10 ORDER BY event_id) AS k FROM messages)
 SELECT c.event_id, max(entry_id) FILTER (place = 1) AS first_callee, max(entry_id) FILTER (place = n) AS last_callee, max(entry_id) FILTER (place = (k - 1) % n + 1) AS round_robin FROM calls c JOIN callees e ON c.realm = e.realm AND c.uri = e.uri GROUP BY c.event_id""")
def load_balancing(read, spark):
    """Callees of calls by three strategies: first, last and round robin. A procedure's callees are one sorted array (there are few), so calls join one row."""
    callees = read("entries").where("policy = 'prefix'").groupBy("realm", "uri").agg(F.sort_array(F.collect_list(F.struct("created_ms", "entry_id"))).alias("c"))
    called = F.concat(F.lit("com.app."), "event_type", F.lit(".u"), F.col("session") % 10)
    calls = R.running(read("messages").select("event_id", "realm", called.alias("uri")), ["realm", "uri"], [(F.expr("event_id div 65536"), False)], [F.col("event_id")], name="k")
    at = lambda i: F.element_at("c", i)["entry_id"]
    return calls.join(callees, ["realm", "uri"]).select("event_id", at(F.lit(1)).alias("first_callee"), at(F.lit(-1)).alias("last_callee"), at((F.pmod(F.col("k") - 1, F.size("c")) + 1).cast("int")).alias("round_robin"))


@query("least_loaded", "entries calls", """, load AS (SELECT callee, count(*) AS queued FROM calls GROUP BY callee) SELECT realm, uri, entry_id, queued FROM (SELECT e.realm, e.uri, entry_id, queued, row_number() OVER (PARTITION BY e.realm, e.uri ORDER BY queued, entry_id) AS place FROM entries e JOIN load ON callee = node WHERE policy = 'prefix') x WHERE place = 1""")
def least_loaded(read, spark):
    """The callee with the shortest queue of each procedure, by a partial aggregate."""
    load = read("calls").groupBy("callee").agg(F.count(F.lit(1)).alias("queued"))
    best = read("entries").where("policy = 'prefix'").join(load, F.col("node") == F.col("callee")).groupBy("realm", "uri").agg(F.min(F.struct("queued", "entry_id")).alias("b"))
    return best.select("realm", "uri", F.col("b.entry_id").alias("entry_id"), F.col("b.queued").alias("queued"))


@query("consistent_hash_callee", "messages entries", """, callees AS (SELECT realm, uri, list(entry_id ORDER BY entry_id) AS c FROM entries WHERE policy = 'prefix' GROUP BY ALL),
 q AS (SELECT event_id, session, c, len(c) AS n FROM messages m JOIN callees e ON m.realm = e.realm AND 'com.app.' || event_type || '.u' || (session % 10) = e.uri),
 jump AS (SELECT event_id, n, session::HUGEINT AS key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM q UNION ALL
 SELECT event_id, n, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM jump WHERE j < n) x)
 SELECT q.event_id, max(b) AS bucket, max(c[b + 1]) FILTER (j >= q.n) AS entry_id FROM q JOIN jump USING (event_id) GROUP BY q.event_id""")
def consistent_hash_callee(read, spark):
    """Callees by jump consistent hash of a routing key."""
    of = read("entries").where("policy = 'prefix'").select("realm", "uri", "entry_id")
    of = B.numbered(of, ["realm", "uri"], [(F.expr("entry_id div 65536"), False)], [F.col("entry_id")]).withColumnRenamed("at", "bucket")
    many = of.groupBy("realm", "uri").agg(F.count(F.lit(1)).alias("n"))
    calls = read("messages").select("event_id", "realm", "session", F.concat(F.lit("com.app."), "event_type", F.lit(".u"), F.col("session") % 10).alias("uri")).join(many, ["realm", "uri"])
    return calls.withColumn("bucket", hashing.jump_hash("session", "n")).join(of, ["realm", "uri", "bucket"]).select("event_id", "bucket", "entry_id")


@query("publish_filter", "messages entries", f""", {MATCHED}, opts AS (SELECT event_id, realm, topic, session AS publisher, event_id % 3 <> 0 AS exclude_me, CASE WHEN event_id % 4 = 0 THEN [session % 97, (session + 1) % 97, (session + 2) % 97] ELSE [] END AS eligible, [(session + 1) % 97] AS excluded FROM messages),
 full_opts AS (SELECT event_id, realm, topic, CASE WHEN exclude_me THEN list_append(excluded, publisher) ELSE excluded END AS excl, eligible FROM opts),
 ok AS (SELECT *, list_filter(eligible, lambda x: NOT list_contains(excl, x)) AS elig FROM full_opts)
 SELECT event_id, count(*) AS receivers, sum(session) AS sessions FROM ok JOIN matched USING (realm, topic) WHERE (len(elig) = 0 OR list_contains(elig, session)) AND NOT list_contains(excl, session) GROUP BY event_id""")
def publish_filter(read, spark):
    """Receivers of each event after eligible and excluded sessions; the publisher is excluded unless it asks to be served."""
    from ..operators.state import deliverable

    m = read("messages").select("event_id", "realm", "topic", F.col("session").alias("publisher"))
    elig = F.when(F.col("event_id") % 4 == 0, F.array(*[(F.col("publisher") + i) % 97 for i in range(3)])).otherwise(F.expr("cast(array() as array<bigint>)"))
    excl = F.array((F.col("publisher") + 1) % 97)
    m = m.withColumn("excl", F.when(F.col("event_id") % 3 != 0, F.array_union(excl, F.array("publisher"))).otherwise(excl)).withColumn("elig", F.array_except(elig, "excl"))
    matched = P.match_patterns(topics(read), read("entries")).select("realm", "topic", "session")
    return m.join(matched, ["realm", "topic"]).where(deliverable(F.col("session"), F.col("elig"), F.col("excl"))).groupBy("event_id").agg(F.count(F.lit(1)).alias("receivers"), F.sum("session").alias("sessions"))


@query("group_id_suppression", "messages entries", f", {MATCHED} SELECT event_id, count(*) AS receivers FROM messages m JOIN matched x USING (realm, topic) WHERE NOT (x.entry_id % 5 = 0 AND m.node <> 'node0') GROUP BY event_id")
def group_id_suppression(read, spark):
    """Grouped subscribers (every fifth) only hear events of local origin."""
    matched = P.match_patterns(topics(read), read("entries")).select("realm", "topic", "entry_id")
    return read("messages").select("event_id", "realm", "topic", "node").join(matched, ["realm", "topic"]).where(~((F.col("entry_id") % 5 == 0) & (F.col("node") != "node0"))).groupBy("event_id").agg(F.count(F.lit(1)).alias("receivers"))


@query("remote_forwards", "messages entries", f", {MATCHED} SELECT DISTINCT event_id, x.node FROM messages m JOIN matched x USING (realm, topic) WHERE x.node <> 'node0'")
def remote_forwards(read, spark):
    """One forwarded copy of an event for each remote node that has a subscriber."""
    nodes = P.match_patterns(topics(read), read("entries")).where("node <> 'node0'").select("realm", "topic", "node").distinct()
    return read("messages").select("event_id", "realm", "topic").join(nodes, ["realm", "topic"]).select("event_id", "node")


@query("local_exact_subscribers", "messages entries", f", {MATCHED} SELECT realm, topic, count(*) AS n, sum(entry_id) AS ids FROM matched WHERE policy = 'exact' AND node = 'node0' AND session NOT IN (3, 4, 5) GROUP BY ALL")
def local_exact_subscribers(read, spark):
    return P.match_patterns(topics(read), read("entries").where((F.col("node") == "node0") & ~F.col("session").isin(3, 4, 5)), policies=("exact",)).groupBy("realm", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum("entry_id").alias("ids"))


@query("registration_consistency", "entries", " SELECT realm, uri, policy, count(*) AS n, CASE WHEN count(DISTINCT invoke) = 1 AND min(invoke) <> 'single' THEN 'allow' WHEN count(*) = 1 THEN 'allow' ELSE 'already_exists' END AS verdict FROM entries GROUP BY realm, uri, policy")
def registration_consistency(read, spark):
    """Procedures whose registrations agree on a shared invocation policy."""
    one = (F.min("invoke") == F.max("invoke")) & (F.min("invoke") != "single")
    return read("entries").groupBy("realm", "uri", "policy").agg(F.count(F.lit(1)).alias("n"), F.when(one | (F.count(F.lit(1)) == 1), "allow").otherwise("already_exists").alias("verdict"))


@query("duplicate_registrations", "entries", " SELECT a.entry_id FROM entries a WHERE EXISTS (SELECT 1 FROM entries b WHERE a.realm = b.realm AND a.uri = b.uri AND a.session % 10 = b.session % 10 AND a.entry_id <> b.entry_id)")
def duplicate_registrations(read, spark):
    """Registrations of one procedure by one session: an equi group, not a self join."""
    e = read("entries").withColumn("s", F.col("session") % 10)
    twice = e.groupBy("realm", "uri", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return e.join(twice, ["realm", "uri", "s"], "left_semi").select("entry_id")


@query("caller_disclosure", "messages entries", f", {MATCHED} SELECT event_id, CASE WHEN coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END, true) THEN session END AS caller FROM messages")
def caller_disclosure(read, spark):
    """The caller is shown if it asks, or doesn't say."""
    asks = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 1)
    return read("messages").select("event_id", F.when(F.coalesce(asks, F.lit(True)), F.col("session")).alias("caller"))


@query("uri_rules", "entries", " SELECT DISTINCT uri, regexp_matches(uri, '^([^ .#]+\\.)*([^ .#]+)$') AS loose, regexp_matches(uri, '^([0-9a-z_]+\\.)*([0-9a-z_]+)$') AS strict, regexp_matches(uri, '^(([0-9a-z_]+\\.)|\\.)*([0-9a-z_]+)?$') AS with_empty, CASE WHEN regexp_matches(uri, '^([0-9a-z_]+\\.)*([0-9a-z_]+)$') THEN 'exact' WHEN regexp_matches(uri, '^(([0-9a-z_]+\\.)|\\.)*([0-9a-z_]+)?$') THEN 'wildcard' ELSE 'prefix' END AS policy, string_split(uri, '.')[1] || '.' || string_split(uri, '.')[2] AS domain, array_to_string(string_split(uri, '.')[3:], '/') AS rest FROM entries")
def uri_rules(read, spark):
    u = F.col("uri")
    parts = U.domain_and_rest(u)
    return read("entries").select("uri").distinct().select("uri", U.valid(u, "loose").alias("loose"), U.valid(u, "strict").alias("strict"), U.valid(u, "strict_allow_empty").alias("with_empty"), U.derived_policy(u).alias("policy"), parts[0].alias("domain"), F.array_join(F.slice(parts, 2, 20), "/").alias("rest"))


@query("uri_encoding", "entries", " SELECT DISTINCT uri, len(uri) + len(list_filter(string_split(uri, '.'), lambda x: x = '')) AS encoded_chars, replace(array_to_string(list_transform(string_split(uri, '.'), lambda x: CASE WHEN x = '' THEN chr(1) ELSE x END), '.'), chr(1), '~') AS encoded, true AS round_trip FROM entries")
def uri_encoding(read, spark):
    u = U.encoded(F.col("uri"))
    return read("entries").select("uri").distinct().select("uri", F.char_length(u).cast("long").alias("encoded_chars"), F.replace(u, F.lit("\0"), F.lit("~")).alias("encoded"), (U.decoded(u) == F.col("uri")).alias("round_trip"))


@query("registry_partitions")
def registry_partitions(read, spark):
    """Entries by the partition of their realm (a seeded 64-bit hash)."""
    return read("entries").groupBy(hashing.partition(F.col("realm"), 8).alias("partition")).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.char_length("uri")).alias("bytes"))
