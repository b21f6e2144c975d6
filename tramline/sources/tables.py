"""The tables of a deployment, derived from the star schema; the SQL text runs in Spark and in other engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KIND = "CASE {x} % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'error' WHEN 2 THEN 'signup' WHEN 3 THEN 'click' ELSE 'purchase' END"
THIRD = "cast(floor({x} / 7) as bigint) % 3"

#: Published events. {ms} is the engine's expression for milliseconds since 1970.
MESSAGES = """SELECT event_id, {ms} AS ts_ms, concat('realm', user_id % 3) AS realm,
 concat('com.app.', event_type, '.u', user_id) AS topic, user_id AS session, concat('node', user_id % 4) AS node,
 event_type, value, props FROM events"""

#: Registered patterns: 60 % exact, 25 % prefix, 15 % wildcard.
ENTRIES = f"""SELECT entry_id, realm, policy, CASE WHEN policy = 'exact' THEN concat('com.app.', kind, '.u', entry_id % 150)
 WHEN policy = 'prefix' THEN concat('com.app.', kind, '.u', entry_id % 10)
 WHEN entry_id % 3 = 0 THEN concat('com.app..u', entry_id % 150) WHEN entry_id % 3 = 1 THEN concat('com..', kind, '.')
 ELSE concat('.app.', kind, '.u', entry_id % 150) END AS uri, invoke, session, node, created_ms
 FROM (SELECT c_custkey AS entry_id, concat('realm', {THIRD.format(x="c_custkey")}) AS realm,
 CASE WHEN c_custkey % 20 < 12 THEN 'exact' WHEN c_custkey % 20 < 17 THEN 'prefix' ELSE 'wildcard' END AS policy,
 {KIND.format(x="c_custkey")} AS kind,
 CASE c_custkey % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'roundrobin' WHEN 2 THEN 'random' ELSE 'first' END AS invoke,
 c_custkey % 97 AS session, concat('node', c_custkey % 4) AS node, 1700000000000 + (c_custkey * 7919) % 100000 AS created_ms FROM customer) x"""

#: A change log of keys: three versions of some, tombstones for a few.
CHANGES = """SELECT s_suppkey % 50 AS k, s_suppkey AS version, s_acctbal AS v, s_suppkey % 11 = 0 AS deleted, concat('node', s_nationkey % 4) AS node FROM supplier"""

#: Calls and responses: an order is a call, its first line the response; line numbers give the delay.
CALLS = "SELECT o_orderkey AS call_id, concat('realm', o_custkey % 3) AS realm, o_custkey AS caller, o_orderkey % 1000 AS sent_ms, 30 + (o_orderkey % 7) * 10 AS timeout_ms, concat('node', o_orderkey % 4) AS callee FROM orders"
RESPONSES = "SELECT l_orderkey AS call_id, concat('realm', o_custkey % 3) AS realm, l_orderkey % 1000 + l_partkey % 100 AS at_ms, l_returnflag = 'R' AS failed, l_suppkey AS payload FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1"

#: Realms, groups, users, grants, sources: a few rows with an override, a diamond and an unknown group, then a row of the
#: star schema each: nations are groups, customers users, suppliers hold grants, parts give ranges, orders connect.
REALMS = "SELECT * FROM (VALUES ('base', NULL, 'sso.base'), ('shop', 'base', NULL), ('lab', 'base', 'sso.lab'), ('solo', NULL, NULL)) AS t(realm, prototype, sso)"
GROUPS = "SELECT * FROM (VALUES ('base', 'staff', 'all,readers'), ('base', 'readers', ''), ('base', 'admins', 'staff'), ('shop', 'staff', 'sellers'), ('shop', 'sellers', 'readers'), ('lab', 'makers', 'staff,readers'), ('solo', 'root', '')) AS t(realm, name, member_of) UNION ALL SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'base' ELSE 'shop' END, concat('nation', n_nationkey), CASE WHEN n_nationkey < 3 THEN 'staff' ELSE concat('nation', cast(floor(n_nationkey / 3) as bigint), ',readers') END FROM nation"
USERS = "SELECT * FROM (VALUES ('shop', 'ann', 'staff,ghost'), ('shop', 'bob', 'admins'), ('lab', 'cid', 'makers'), ('lab', 'dee', ''), ('solo', 'eve', 'root'), ('shop', 'ALIAS', 'alias')) AS t(realm, username, member_of) UNION ALL SELECT CASE WHEN c_custkey % 7 = 0 THEN 'lab' ELSE 'shop' END, concat('c', c_custkey), CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('nation', c_nationkey) WHEN 2 THEN concat('sellers,nation', c_nationkey) ELSE 'staff,ghost' END FROM customer"
GRANTS = "SELECT * FROM (VALUES ('base', 'group', 'readers', 'com.app', 'prefix', 'subscribe'), ('base', 'group', 'staff', 'com.app.view', 'exact', 'call,publish'), ('base', 'group', 'admins', '', 'prefix', 'call,register,subscribe,publish'), ('shop', 'group', 'sellers', 'com..purchase', 'wildcard', 'publish'), ('shop', 'user', 'ann', 'com.app.view', 'exact', 'register'), ('lab', 'group', 'makers', 'com.app.error', 'exact', 'call'), ('lab', 'user', 'dee', 'com.app', 'prefix', 'call'), ('shop', 'group', 'staff', 'com.app.view', 'exact', 'cancel')) AS t(realm, role_type, role, uri, policy, permissions) UNION ALL SELECT 'shop', CASE WHEN s_suppkey % 3 = 0 THEN 'group' ELSE 'user' END, CASE WHEN s_suppkey % 3 = 0 THEN concat('nation', s_nationkey) ELSE concat('c', s_suppkey) END, CASE s_suppkey % 3 WHEN 0 THEN 'com.app' WHEN 1 THEN 'com.app.error' ELSE 'com..view' END, CASE s_suppkey % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'exact' ELSE 'wildcard' END, CASE WHEN s_suppkey % 2 = 0 THEN 'call,subscribe' ELSE 'publish' END FROM supplier"
SOURCES = "SELECT * FROM (VALUES ('shop', 'ann', '10.0.0.0/8', 'password'), ('shop', 'ann', '10.1.0.0/16', 'cryptosign'), ('shop', 'all', '0.0.0.0/0', 'anonymous'), ('shop', 'all', '10.1.2.0/24', 'ticket'), ('lab', 'cid', '192.168.1.0/24', 'password'), ('lab', 'all', '192.168.0.0/16', 'oauth2')) AS t(realm, username, cidr, method) UNION ALL SELECT 'shop', concat('c', s_suppkey), concat('10.', s_suppkey % 8, '.', s_nationkey, '.0/', 16 + s_suppkey % 9), 'ticket' FROM supplier"
CONNECTIONS = "SELECT * FROM (VALUES (1, 'shop', 'ann', '10.1.2.3'), (2, 'shop', 'ann', '10.9.9.9'), (3, 'shop', 'bob', '10.1.2.9'), (4, 'lab', 'cid', '192.168.1.77'), (5, 'lab', 'dee', '192.168.9.1'), (6, 'shop', 'ann', '172.16.0.1')) AS t(conn, realm, username, ip) UNION ALL SELECT o_orderkey + 100, 'shop', concat('c', o_custkey % 100 + 1), concat('10.', (o_custkey % 100 + 1) % 8, '.', o_orderkey % 25, '.', o_orderkey % 250) FROM orders"

SPARK_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
TEXTS = {"messages": MESSAGES, "entries": ENTRIES, "changes": CHANGES, "calls": CALLS, "responses": RESPONSES, "realms": REALMS, "groups": GROUPS, "users": USERS, "grants": GRANTS, "sources": SOURCES, "connections": CONNECTIONS}
USED = {"messages": ["events"], "entries": ["customer"], "changes": ["supplier"], "calls": ["orders"], "responses": ["lineitem", "orders"], "groups": ["nation"], "users": ["customer"], "grants": ["supplier"], "sources": ["supplier"], "connections": ["orders"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; only the Parquet columns it needs are read."""
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in USED.get(name, ())}
    text = TEXTS[name].replace("{ms}", SPARK_MS)
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **sources) if sources else spark.sql(text)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
