"""Queries on callees, calls followed to their end, external records, validation, jobs, events and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import msgpack, records, scalars
from ..operators import balance as B
from ..operators import events as E
from ..operators import patterns as P
from ..operators import registry as R
from ..operators import state as S
from ..sources import files
from .registry import query
from .routing import MATCHED, ORDER, topics
from .tables import OUTCOMES

CALLED = "'com.app.' || event_type || '.u' || (session % 10)"
CALLEES = """load AS (SELECT callee, count(*) AS queued FROM calls GROUP BY callee),
 ranked AS (SELECT e.*, queued, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY realm, uri) AS n FROM entries e JOIN load ON callee = node WHERE policy = 'prefix' WINDOW w AS (PARTITION BY realm, uri ORDER BY created_ms, entry_id)),
 lists AS (SELECT realm, uri, list({'entry_id': entry_id, 'queued': queued, 'invoke': invoke} ORDER BY place) AS c, max(n) AS n FROM ranked GROUP BY realm, uri)"""


def callees(read):
    load = read("calls").groupBy("callee").agg(F.count(F.lit(1)).alias("queued"))
    of = read("entries").where("policy = 'prefix'").join(load, F.col("node") == F.col("callee"))
    return of.groupBy("realm", "uri").agg(F.sort_array(F.collect_list(F.struct("created_ms", "entry_id", "queued", "invoke"))).alias("c"))


def called(read):
    uri = F.concat(F.lit("com.app."), "event_type", F.lit(".u"), F.col("session") % 10)
    return read("messages").select("event_id", "realm", "session", uri.alias("uri"))


@query("sampled_callee", "messages entries calls", f""", {CALLEES}, q AS (SELECT event_id, c[(event_id * 7919) % n + 1] AS a, c[(event_id * 104729 + 13) % n + 1] AS b FROM messages m JOIN lists l ON m.realm = l.realm AND {CALLED} = l.uri)
 SELECT event_id, CASE WHEN b.queued < a.queued THEN b.entry_id ELSE a.entry_id END AS entry_id, least(a.queued, b.queued) AS queued FROM q""")
def sampled_callee(read, spark):
    """Of two callees drawn, the one with the shorter queue."""
    x = called(read).join(callees(read), ["realm", "uri"]).withColumn("x", B.sampled(F.col("c"), "queued", F.col("event_id") * 7919, F.col("event_id") * 104729 + 13))
    return x.select("event_id", "x.entry_id", "x.queued")


@query("selected_callee", "messages entries calls", f""", {CALLEES}, k AS (SELECT event_id, realm, {CALLED} AS uri, row_number() OVER (PARTITION BY realm, event_type, session % 10 ORDER BY event_id) AS turn FROM messages)
 SELECT event_id, CASE c[1].invoke WHEN 'roundrobin' THEN c[(turn - 1) % n + 1].entry_id WHEN 'random' THEN c[(event_id * 7919) % n + 1].entry_id ELSE c[1].entry_id END AS entry_id FROM k JOIN lists l ON k.realm = l.realm AND k.uri = l.uri""")
def selected_callee(read, spark):
    """The callee by the policy of the first registration; turns of a hot procedure are counted by groups."""
    turns = R.running(called(read), ["realm", "uri"], [(F.expr("event_id div 65536"), False)], [F.col("event_id")], name="turn")
    load = read("calls").groupBy("callee").agg(F.count(F.lit(1)).alias("queued"))
    of = read("entries").where("policy = 'prefix'").join(load, F.col("node") == F.col("callee")).select("realm", "uri", "created_ms", "entry_id", "queued", "invoke")
    of = B.numbered(of, ["realm", "uri"], [(F.expr("created_ms div 1000"), False)], [F.col("created_ms"), F.col("entry_id")])
    at = B.index_of(F.col("invoke"), F.col("n"), F.col("turn"), F.col("event_id") * 7919, F.col("session"), F.col("least"))
    x = turns.join(B.indexed(of, ["realm", "uri"]), ["realm", "uri"]).select("event_id", "realm", "uri", at.alias("at"))
    return x.join(of.select("realm", "uri", "at", "entry_id"), ["realm", "uri", "at"], "left").select("event_id", "entry_id")


@query("call_routing", "messages entries", f""", {MATCHED}, best AS (SELECT realm, topic, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY realm, topic ORDER BY {ORDER.format(node='')}) AS place FROM matched) x WHERE place = 1),
 c AS (SELECT event_id, realm, topic, event_id % 1000 AS sent, event_id % 1000 + 30 AS expiry, CASE WHEN event_id % 4 > 0 THEN event_id % 1000 + event_id % 60 END AS answer, event_id % 5 = 0 AS failed FROM messages)
 SELECT event_id, entry_id, CASE WHEN entry_id IS NULL THEN 'no_such_procedure' WHEN answer <= expiry AND failed THEN 'error' WHEN answer <= expiry THEN 'result' ELSE 'timeout' END AS outcome, CASE WHEN entry_id IS NULL THEN sent WHEN answer <= expiry THEN answer ELSE expiry END AS done_ms FROM c LEFT JOIN best USING (realm, topic)""")
def call_routing(read, spark):
    """Calls followed from the registration they reach to their outcome."""
    m = read("messages")
    calls = m.select("realm", F.col("event_id").alias("call_id"), F.col("topic").alias("procedure"), (F.col("event_id") % 1000).alias("sent_ms"), F.lit(30).alias("timeout_ms"))
    answers = m.where("event_id % 4 > 0").select("realm", F.col("event_id").alias("call_id"), F.expr("event_id % 1000 + event_id % 60").alias("at_ms"), F.expr("event_id % 5 = 0").alias("failed"), F.lit(0).alias("payload"))
    best = P.best_match(P.match_patterns(topics(read), P.best_entries(read("entries"))), ["realm", "topic"]).select("realm", "topic", "entry_id")
    return B.routed(calls, best, answers).select(F.col("call_id").alias("event_id"), "entry_id", "outcome", "done_ms")


@query("calls_removed", "calls responses", f", {OUTCOMES} SELECT callee = 'node2' AND sent_ms <= 500 AND done_ms > 500 AS removed, count(*) AS n, min(call_id) AS least FROM done GROUP BY ALL")
def calls_removed(read, spark):
    """Pending calls of a callee that goes, taken out, and those that stay."""
    d = S.correlate(read("calls"), read("responses"))
    gone, left = R.take(d, d.where("callee = 'node2' and sent_ms <= 500 and done_ms > 500"), ["realm", "call_id"])
    both = gone.withColumn("removed", F.lit(True)).unionByName(left.withColumn("removed", F.lit(False)))
    return both.groupBy("removed").agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("least"))


@query("owned_view", "changes", """, mine AS (SELECT * FROM changes WHERE node = 'node1'), a AS (SELECT * FROM changes WHERE version % 2 = 0), b AS (SELECT * FROM changes WHERE version % 2 = 1 AND node <> 'node1'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
 SELECT k, version, node FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS place FROM u) x WHERE place = 1 AND NOT deleted""")
def owned_view(read, spark):
    """A merge in which rows of this node's own entries are only believed from this node itself."""
    c = read("changes")
    return R.latest(R.owned_merge(c.where("version % 2 = 0"), c.where("version % 2 = 1"), "node", "node1"), ["k"], ["version"]).select("k", "version", "node")


@query("owner_delete", "entries", " SELECT realm, node, count(*) AS remaining FROM entries WHERE NOT (node = 'node1' AND session IN (5, 7, 9) AND entry_id % 2 = 0) GROUP BY ALL")
def owner_delete(read, spark):
    """Entries are deleted by their owner (node and session) alone."""
    asked = read("entries").where("entry_id % 2 = 0").select("entry_id", F.lit("node1").alias("node"), F.explode(F.array(*(F.lit(x).cast("long") for x in (5, 7, 9)))).alias("session"))
    return R.without(read("entries"), asked, ["entry_id", "node", "session"]).groupBy("realm", "node").agg(F.count(F.lit(1)).alias("remaining"))


@query("guarded_lookup", "entries", " SELECT entry_id, uri FROM entries WHERE realm = 'realm1' AND policy = 'exact' AND session > 90 ORDER BY uri, entry_id LIMIT 5")
def guarded_lookup(read, spark):
    """An index scan with a guard and a limit."""
    return R.page(R.find(read("entries"), realm="realm1", policy="exact").where("session > 90").select("uri", "entry_id"), ["uri", "entry_id"], 5)


@query("ordered_scan", "entries", " SELECT uri, entry_id, row_number() OVER (ORDER BY uri, entry_id) AS place FROM entries WHERE starts_with(uri, 'com.app.click')")
def ordered_scan(read, spark):
    """A prefix of the trie in order, numbered by groups of equal texts."""
    e = read("entries").where(F.startswith("uri", F.lit("com.app.click"))).withColumn("all", F.lit(0))
    return R.running(e, ["all"], [(F.col("uri"), False)], [F.col("entry_id")]).select("uri", "entry_id", "place")


@query("resumed_matches", "messages entries", f", {MATCHED} SELECT topic, entry_id FROM matched WHERE realm = 'realm1' AND (topic, entry_id) > ('com.app.error.u5', 100) ORDER BY ALL LIMIT 50")
def resumed_matches(read, spark):
    """The next page of a limited match after its cursor."""
    m = P.match_patterns(topics(read).where("realm = 'realm1'"), read("entries")).select("topic", "entry_id")
    return R.page(m, ["topic", "entry_id"], 50, ("com.app.error.u5", 100))


@query("merged_pages", "messages entries", f", {MATCHED} SELECT topic, entry_id, policy FROM matched WHERE realm = 'realm2' AND (topic, entry_id) > ('com.app.click.u9', 7) ORDER BY topic, entry_id LIMIT 40")
def merged_pages(read, spark):
    """Pages of the three policies put together under one cursor: the least rows of all go on."""
    t = topics(read).where("realm = 'realm2'")
    pages = [R.page(P.match_patterns(t, read("entries"), policies=(p,)).select("topic", "entry_id", "policy"), ["topic", "entry_id"], 40, ("com.app.click.u9", 7)) for p in P.POLICIES]
    return R.merged_pages(pages, ["topic", "entry_id"], 40)


@query("session_page", "messages", " SELECT DISTINCT session, realm FROM messages WHERE session > 20 ORDER BY session, realm LIMIT 25")
def session_page(read, spark):
    return R.page(read("messages").select("session", "realm").distinct().where("session > 20"), ["session", "realm"], 25)


@query("external_sessions", "messages", """, s AS (SELECT session, realm, node, min(ts_ms) AS opened FROM messages GROUP BY ALL) SELECT session, concat('{"session":', session, ',"realm":"', realm, '","details":{', CASE WHEN session % 2 = 0 THEN concat('"agent":"a', session, '",') ELSE '' END, '"node":"', node, '","opened_ms":', opened, '}}') AS record FROM s""")
def external_sessions(read, spark):
    s = read("messages").groupBy("session", "realm", "node").agg(F.min("ts_ms").alias("opened"))
    agent = F.when(F.col("session") % 2 == 0, F.concat(F.lit("a"), F.col("session").cast("string")))
    return s.select("session", F.to_json(records.external_session(F.col("session"), F.col("realm"), F.col("node"), F.col("opened"), agent)).alias("record"))


@query("external_realms", "realms", """ SELECT concat('{"uri":"', realm, '",', CASE WHEN prototype IS NULL THEN '' ELSE concat('"prototype_uri":"', prototype, '",') END, '"is_sso":', CASE WHEN sso IS NULL THEN 'false' ELSE 'true' END, '}') AS record FROM realms""")
def external_realms(read, spark):
    return read("realms").select(F.to_json(records.external_realm(F.col("realm"), F.col("prototype"), F.col("sso"))).alias("record"))


@query("external_grants", "grants", """ SELECT realm, role_type || '/' || role AS role, CASE WHEN uri = '' THEN '*' ELSE uri END AS uri, CASE WHEN uri = '' THEN 'any' ELSE policy END AS match, array_to_string(list_sort(string_split(permissions, ',')), ',') AS permissions FROM grants""")
def external_grants(read, spark):
    g = read("grants").withColumn("g", records.external_grant(F.col("role_type"), F.col("role"), F.col("uri"), F.col("policy"), F.split("permissions", ",")))
    return g.select("realm", "g.role", "g.resource.uri", "g.resource.match", F.array_join("g.permissions", ",").alias("permissions"))


@query("grant_fallback", "realms grants", ", own AS (SELECT DISTINCT realm, role FROM grants WHERE role_type = 'group') SELECT realm, role, uri, realm AS origin FROM grants WHERE role_type = 'group' UNION ALL SELECT r.realm, g.role, g.uri, g.realm FROM realms r JOIN grants g ON g.realm = r.prototype WHERE role_type = 'group' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.realm = r.realm AND o.role = g.role)")
def grant_fallback(read, spark):
    """Grants of groups from the realm, or from its prototype for groups that the realm grants nothing."""
    g = read("grants").where("role_type = 'group'").select("realm", "role", "uri")
    own = g.select("*", F.col("realm").alias("origin"))
    inherited = read("realms").join(g.withColumnRenamed("realm", "origin"), F.col("prototype") == F.col("origin")).select("realm", "role", "uri", "origin")
    return own.unionByName(inherited.join(g.select("realm", "role").distinct(), ["realm", "role"], "left_anti"))


@query("unknown_roles", "grants groups users", " SELECT realm, role_type, role FROM grants g WHERE NOT EXISTS (SELECT 1 FROM groups x WHERE g.role_type = 'group' AND x.realm = g.realm AND x.name = g.role) AND NOT EXISTS (SELECT 1 FROM users u WHERE g.role_type = 'user' AND u.realm = g.realm AND u.username = g.role) GROUP BY ALL")
def unknown_roles(read, spark):
    """Roles of grants that are neither a group nor a user of their realm."""
    known = read("groups").select("realm", F.lit("group").alias("role_type"), F.col("name").alias("role")).unionByName(read("users").select("realm", F.lit("user").alias("role_type"), F.col("username").alias("role")))
    return read("grants").select("realm", "role_type", "role").distinct().join(known, ["realm", "role_type", "role"], "left_anti")


@query("realm_levels", "realms", ", lv AS (SELECT realm, 0 AS level FROM realms WHERE prototype IS NULL UNION ALL SELECT r.realm, lv.level + 1 FROM realms r JOIN lv ON r.prototype = lv.realm) SELECT realm, CAST(level AS BIGINT) AS level FROM lv")
def realm_levels(read, spark):
    """Realms in an order in which prototypes come first."""
    from ..operators import access as A

    r = read("realms")
    return A.levels(r.where("prototype is not null").select(F.col("realm").alias("node"), F.col("prototype").alias("needs")), r.select(F.col("realm").alias("node"))).select(F.col("node").alias("realm"), F.col("level").cast("long").alias("level"))


OPTIONS = {"match": records.Field(default="exact", check=lambda x: x.isin("exact", "prefix", "wildcard")), "timeout": records.Field("bigint", check=lambda x: x >= 0), "retain": records.Field("boolean", default="false"), "topic": records.Field(required=True)}


@query("validated_options", "messages", """, o AS (SELECT event_id, topic, CASE WHEN event_id % 4 = 0 THEN 'regex' WHEN event_id % 4 = 1 THEN 'prefix' END AS m, CASE event_id % 3 WHEN 0 THEN '-5' WHEN 1 THEN 'x' ELSE '30' END AS t, event_id % 7 > 0 AS has FROM messages)
 SELECT event_id, coalesce(m, 'exact') AS match, CASE WHEN t = 'x' THEN NULL ELSE CAST(CASE WHEN t = 'x' THEN '0' ELSE t END AS BIGINT) END AS timeout, false AS retain, array_to_string(list_filter([CASE WHEN m = 'regex' THEN 'match: out of range' END, CASE t WHEN '-5' THEN 'timeout: out of range' WHEN 'x' THEN 'timeout: not a bigint' END, CASE WHEN NOT has THEN 'topic: missing' END], lambda x: x IS NOT NULL), '; ') AS errors, '_trace' AS extra FROM o""")
def validated_options(read, spark):
    """Options against a spec: defaults, types, checks, unknown keys dropped, extensions kept."""
    match = F.when(F.col("event_id") % 4 == 0, "regex").when(F.col("event_id") % 4 == 1, "prefix")
    timeout = F.when(F.col("event_id") % 3 == 0, "-5").when(F.col("event_id") % 3 == 1, "x").otherwise("30")
    values = F.create_map(F.lit("match"), match, F.lit("timeout"), timeout, F.lit("topic"), F.when(F.col("event_id") % 7 > 0, F.col("topic")), F.lit("other"), F.lit("1"), F.lit("_trace"), F.lit("t"))
    v = read("messages").select("event_id", records.validated(values, OPTIONS, "^_").alias("v"))
    return v.select("event_id", "v.fields.match", "v.fields.timeout", "v.fields.retain", F.array_join("v.errors", "; ").alias("errors"), F.array_join(F.map_keys("v.extra"), ",").alias("extra"))


@query("small_functions", "messages", """, m AS (SELECT *, (event_id % 1000) / 1000.0::DOUBLE AS draw, event_id % 64 AS mask FROM messages) SELECT event_id, CAST(1 + floor(draw * 9007199254740992.0::DOUBLE) AS BIGINT) AS id, (event_id * 1500) // 1000 AS elapsed_ms, least((event_id % 50) * 2, 60) AS doubled, event_id % 50 + CAST(floor(draw * (2 * (event_id % 50) + 1)) AS BIGINT) AS jittered,
 mask & 4 = 4 AS has, mask | 8 AS plus, mask & ~2 AS less, mask & 5 = 5 AS fits, concat(event_type, '~', topic) AS key, topic AS part, concat(rpad(event_type, 8, ' '), ' | ', rpad(node, 6, ' ')) AS line FROM m""")
def small_functions(read, spark):
    """Random ids, elapsed time, increments, flags, index keys and table lines."""
    draw, n, mask = (F.col("event_id") % 1000) / F.lit(1000.0), F.col("event_id") % 50, F.col("event_id") % 64
    key = records.index_key(F.col("event_type"), F.col("topic"))
    return read("messages").select(
        "event_id", records.random_id(draw).alias("id"), records.elapsed(F.lit(0), F.col("event_id") * 1500, "millisecond").alias("elapsed_ms"), records.increment(n, 60).alias("doubled"), records.jittered(n, draw).alias("jittered"),
        records.enabled(mask, 4).alias("has"), records.enable(mask, 8).alias("plus"), records.disable(mask, 2).alias("less"), records.compatible(mask, F.lit(5)).alias("fits"),
        F.replace(key, F.lit("\0"), F.lit("~")).alias("key"), records.index_parts(key, 2)[1].alias("part"), records.table_line([F.col("event_type"), F.col("node")], [8, 6]).alias("line"),
    )


@query("ticket_merge", "messages", """, a AS (SELECT session, max(event_id) AS id, max(ts_ms) AS expiry FROM messages GROUP BY session) SELECT session, CASE WHEN id % 2 = 0 THEN concat(id, '@', expiry + 5) ELSE concat(id + 1, '@', expiry - 9, ',', id, '@', expiry) END AS tickets FROM a""")
def ticket_merge(read, spark):
    """Two ticket lists merged: distinct, sorted by expiry, of one id the later expiry."""
    a = read("messages").groupBy("session").agg(F.max("event_id").alias("id"), F.max("ts_ms").alias("expiry"))
    one = F.array(F.struct("expiry", "id"))
    other = F.when(F.col("id") % 2 == 0, F.array(F.struct((F.col("expiry") + 5).alias("expiry"), "id"))).otherwise(F.array(F.struct("expiry", "id"), F.struct((F.col("expiry") - 9).alias("expiry"), (F.col("id") + 1).alias("id"))))
    return a.select("session", F.array_join(F.transform(records.merged_tickets(one, other), lambda x: F.concat_ws("@", x["id"], x["expiry"])), ",").alias("tickets"))


@query("relation_family", "entries", " SELECT uri, string_agg(DISTINCT CAST(session % 4 AS VARCHAR), ',' ORDER BY CAST(session % 4 AS VARCHAR)) AS arities FROM entries WHERE policy = 'prefix' GROUP BY uri")
def relation_family(read, spark):
    """Pairs restricted to some names, as a family: name -> its values."""
    return read("entries").where("policy = 'prefix'").groupBy("uri").agg(F.array_join(F.array_sort(F.collect_set((F.col("session") % 4).cast("string"))), ",").alias("arities"))


@query("group_meta", "entries", " SELECT realm, invoke, CASE WHEN count(DISTINCT node) = 1 THEN min(node) ELSE '[' || string_agg(DISTINCT node, ',' ORDER BY node) || ']' END AS node FROM entries GROUP BY ALL")
def group_meta(read, spark):
    """Metadata merged over rows: values united, a single one unwrapped."""
    g = read("entries").groupBy("realm", "invoke").agg(F.array_sort(F.collect_set("node")).alias("v"))
    return g.select("realm", "invoke", F.when(F.size("v") == 1, F.col("v")[0]).otherwise(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]"))).alias("node"))


@query("job_queue", "messages", ", j AS (SELECT *, row_number() OVER (PARTITION BY session % 8 ORDER BY event_id) AS place, max(ts_ms) OVER () AS now FROM messages) SELECT session % 8 AS part, place // 11 AS x, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session % 8 ORDER BY event_id) AS kept FROM j WHERE ts_ms > now - 864000000) y WHERE kept <= 10")
def job_queue(read, spark):
    """Jobs of partitions in order: those within their age, the first ten of each."""
    m = read("messages").withColumn("part", F.col("session") % 8)
    now = read("messages").agg(F.max("ts_ms").alias("now"))
    jobs = R.running(m, ["part"], [(F.expr("event_id div 65536"), False)], [F.col("event_id")])
    fresh = jobs.join(F.broadcast(now), F.lit(True)).where("ts_ms > now - 864000000")  # one row
    return E.first_jobs(fresh, "part", "event_id", 10).select("part", F.expr("place div 11").alias("x"), "event_id")


@query("meta_events", "messages", """, log AS (SELECT event_id, realm, topic, row_number() OVER (PARTITION BY realm, topic ORDER BY event_id) AS n FROM messages) SELECT event_id, realm, 'wamp.subscription.on_subscribe' AS meta_topic, topic AS subject FROM log UNION ALL SELECT event_id, realm, 'wamp.subscription.on_create', topic FROM log WHERE n = 1""")
def meta_events(read, spark):
    """Internal events published again as topics: a created topic is told apart from a further subscriber."""
    log = R.running(read("messages"), ["realm", "topic"], [(F.expr("event_id div 65536"), False)], [F.col("event_id")], name="n")
    return E.meta_events(log, {"wamp.subscription.on_subscribe": F.lit(True), "wamp.subscription.on_create": F.col("n") == 1}, "topic").select("event_id", "realm", "meta_topic", "subject")


@query("handled_events", "messages", " SELECT handler, count(*) AS n, sum(event_id) AS ids FROM (SELECT 'errors' AS handler, event_id FROM messages WHERE event_type = 'error' UNION ALL SELECT 'all', event_id FROM messages) x GROUP BY handler")
def handled_events(read, spark):
    """An event bus: each handler sees the events that its guard lets through, in one pass over them."""
    bus = E.Bus()
    bus.add("errors", F.col("event_type") == "error")
    bus.add("all", F.lit(True))
    return bus.notified(read("messages")).groupBy("handler").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("cached_tokens", "messages", ", r AS (SELECT session, ts_ms, lag(ts_ms) OVER (PARTITION BY session ORDER BY ts_ms, event_id) AS before, event_id FROM messages) SELECT session, count(*) AS asked, sum(CASE WHEN before IS NULL OR ts_ms - before >= 3600000 THEN 1 ELSE 0 END) AS fetched FROM r GROUP BY session")
def cached_tokens(read, spark):
    """Tokens fetched for services when the cached one would expire before its next use."""
    return E.fetches(read("messages"), "session", "ts_ms", "event_id", 3_600_000)


@query("callbacks", "messages", " SELECT event_id, CASE event_type WHEN 'click' THEN CAST(session * 2 AS VARCHAR) WHEN 'error' THEN 'wamp.error.invalid_argument' ELSE 'wamp.error.no_such_procedure' END AS answer FROM messages")
def callbacks(read, spark):
    """Procedures answered by registered functions; a wrong number of arguments or an unknown name is an error."""
    r = E.Callbacks()
    r.register("click", lambda x: (x * 2).cast("string"), 1)
    r.register("error", lambda x, y: x + y, 2)
    return read("messages").select("event_id", r.answer(F.col("event_type"), [F.col("session")]).alias("answer"))


@query("listed_entries", "", "SELECT r.v AS realm, CAST(i AS BIGINT) AS place, r.v || '.' || CAST(i AS VARCHAR) AS name FROM (VALUES ('a'), ('b')) r(v), range(1, 4) x(i)")
def listed_entries(read, spark):
    """A procedure that returns a list, as a table function joined with its arguments."""
    spark.udtf.register("tramline_listed", E.Listed)
    return spark.sql("SELECT r.realm, t.place, t.name FROM VALUES ('a'), ('b') AS r(realm), LATERAL tramline_listed(r.realm, 3) t")


@query("msgpack_round_trip", "messages", " SELECT event_id, replace(props, ' ', '') AS json, 4 + CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 128 THEN 0 ELSE 1 END AS bytes FROM messages")
def msgpack_round_trip(read, spark):
    """JSON payloads as MessagePack and back."""
    m = read("messages").select("event_id", msgpack.from_json_text("props").alias("b"))
    return m.select("event_id", msgpack.to_json_text("b").alias("json"), F.octet_length("b").cast("long").alias("bytes"))


@query("packed_messages", "messages", """ SELECT event_id, concat('[16,', event_id, ',{},"', topic, '",[', replace(props, ' ', ''), ']]') AS publish, concat('[36,', session, ',', event_id, ',{}]') AS event, concat('[48,', event_id, ',{},"', topic, '"]') AS call FROM messages""")
def packed_messages(read, spark):
    """Records of three kinds as positional arrays; trailing fields that are missing are left off."""
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)
    fields = {"request": F.col("event_id").cast("string"), "options": F.lit("{}"), "topic": text(F.col("topic")), "args": F.concat(F.lit("["), F.replace("props", F.lit(" "), F.lit("")), F.lit("]"))}
    event = {"subscription": F.col("session").cast("string"), "publication": F.col("event_id").cast("string"), "details": F.lit("{}")}
    call = {"request": fields["request"], "options": fields["options"], "procedure": fields["topic"]}
    return read("messages").select("event_id", files.packed("PUBLISH", fields).alias("publish"), files.packed("EVENT", event).alias("event"), files.packed("CALL", call).alias("call"))


@query("ipv6_sources", "messages", " SELECT event_id, session % 16 = 10 AS inside, session % 2 = 0 AS narrow, true AS outside FROM messages")
def ipv6_sources(read, spark):
    """IPv6 addresses in ranges, by expressions."""
    from ..functions import net

    ip = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("session") % 16)), F.lit(":"), F.lower(F.hex(F.col("session") % 2)))
    return read("messages").select("event_id", net.in_range6(ip, "2001:db8::a:0/112").alias("inside"), net.in_range6(F.concat(F.lit("fe80::"), F.lower(F.hex(F.col("session") % 2))), "fe80::/127").alias("outside"), net.in_range6(F.concat(F.lit("::"), F.lower(F.hex(F.col("session") % 2))), "::/128").alias("narrow"))


@query("bucket_verbs", "messages", " SELECT event_id, CASE event_id % 4 WHEN 3 THEN 3 ELSE event_id % 4 END AS peek, CASE WHEN event_id % 4 >= 1 THEN 0 ELSE 1000 END AS wait_ms, 3 AS reset FROM messages")
def bucket_verbs(read, spark):
    """A token bucket looked at, waited for, and reset: two seconds after its tokens were counted, one token a second is left out."""
    tokens = F.col("event_id") % 4
    return read("messages").select("event_id", S.peek(tokens, F.lit(0), F.lit(500), 3, 1 / 1000).alias("peek"), S.wait(tokens, F.lit(0), F.lit(0), 3, 1 / 1000).alias("wait_ms"), S.full(3).alias("reset"))
