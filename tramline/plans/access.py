"""Queries on users, groups, grants and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as A
from .registry import query

MEMBERS = "list_filter(string_split({x}, ','), lambda x: x <> '')"
RESOLVED = "resolved AS (SELECT realm, name, member_of, realm AS origin FROM groups UNION ALL SELECT r.realm, g.name, g.member_of, g.realm FROM realms r JOIN groups g ON g.realm = r.prototype WHERE NOT EXISTS (SELECT 1 FROM groups o WHERE o.realm = r.realm AND o.name = g.name))"
CLOSURE = f"""{RESOLVED}, edges AS (SELECT realm, name, unnest({MEMBERS.format(x='member_of')}) AS parent FROM resolved),
 reach AS (SELECT realm, username, unnest({MEMBERS.format(x='member_of')}) AS name FROM users UNION SELECT r.realm, r.username, e.parent FROM reach r JOIN edges e ON e.realm = r.realm AND e.name = r.name),
 member AS (SELECT DISTINCT r.realm, r.username, r.name, g.origin FROM reach r JOIN resolved g ON g.realm = r.realm AND g.name = r.name)"""
USER_GRANTS = f"""{CLOSURE}, granted AS (SELECT realm, role_type, role, uri, policy, unnest(string_split(permissions, ',')) AS permission FROM grants),
 ug AS (SELECT DISTINCT m.realm, m.username, g.uri, g.policy, g.permission FROM member m JOIN granted g ON g.realm = m.origin AND g.role = m.name AND role_type = 'group' UNION SELECT u.realm, u.username, g.uri, g.policy, g.permission FROM users u JOIN granted g ON g.realm = u.realm AND g.role = u.username AND role_type = 'user')"""
REQUESTS = "SELECT u.realm, u.username, p.permission, r.resource FROM users u, (VALUES ('call'), ('publish'), ('register'), ('subscribe'), ('cancel')) p(permission), (VALUES ('com.app.view'), ('com.app.error'), ('com.x.purchase'), ('com.application')) r(resource)"


def closure_sql(body: str) -> str:
    return ", " + body


@query("group_closure", "realms groups users", closure_sql(f"{CLOSURE} SELECT realm, username, name, origin FROM member"))
def group_closure(read, spark):
    """All groups of each user, an own group hiding the prototype's of the same name."""
    return A.closure(spark, read("users"), A.resolved_groups(read("groups"), read("realms"))).select("realm", "username", "name", "origin")


@query("user_grants", "realms groups users grants", closure_sql(f"{USER_GRANTS} SELECT realm, username, uri, policy, string_agg(DISTINCT permission, ',' ORDER BY permission) AS permissions FROM ug GROUP BY ALL"))
def user_grants(read, spark):
    """Grants of each user by resource."""
    g = A.user_grants(spark, read("users"), read("groups"), read("realms"), read("grants"))
    return g.groupBy("realm", "username", "uri", "policy").agg(F.array_join(F.array_sort(F.collect_set("permission")), ",").alias("permissions"))


@query("authorize", "realms groups users grants", closure_sql(f"""{USER_GRANTS}, requests AS ({REQUESTS}) SELECT q.*, EXISTS (SELECT 1 FROM ug e WHERE e.realm = q.realm AND e.username = q.username AND e.permission = q.permission AND CASE e.policy WHEN 'exact' THEN q.resource = e.uri WHEN 'prefix' THEN starts_with(q.resource, e.uri)
 ELSE len(string_split(q.resource, '.')) = len(string_split(e.uri, '.')) AND list_bool_and(list_transform(list_zip(string_split(q.resource, '.'), string_split(e.uri, '.')), lambda z: (z[2] = '' AND z[1] <> '') OR (z[2] <> '' AND z[1] = z[2]))) END) AS allowed FROM requests q"""))
def authorize(read, spark):
    """Whether each user may do each thing to each resource."""
    permissions, resources = (F.array(*map(F.lit, x)) for x in (("call", "publish", "register", "subscribe", "cancel"), ("com.app.view", "com.app.error", "com.x.purchase", "com.application")))
    requests = read("users").select("realm", "username", F.explode(permissions).alias("permission")).select("*", F.explode(resources).alias("resource"))
    return A.authorized(requests, A.user_grants(spark, read("users"), read("groups"), read("realms"), read("grants")))


@query("unknown_groups", "realms groups users", closure_sql(f"{RESOLVED} SELECT realm, name FROM (SELECT realm, unnest({MEMBERS.format(x='member_of')}) AS name FROM users) x WHERE NOT EXISTS (SELECT 1 FROM resolved g WHERE g.realm = x.realm AND g.name = x.name) GROUP BY ALL"))
def unknown_groups(read, spark):
    """Groups that users name but neither their realm nor its prototype has."""
    named = read("users").select("realm", F.explode(A.listed("member_of")).alias("name")).distinct()
    return named.join(A.resolved_groups(read("groups"), read("realms")).select("realm", "name"), ["realm", "name"], "left_anti")


@query("grant_and_revoke", "grants", " SELECT realm, role, uri, array_to_string(list_sort(list_distinct(list_concat(string_split(permissions, ','), ['call', 'cancel']))), ',') AS granted, array_to_string(list_sort(list_filter(string_split(permissions, ','), lambda x: x <> 'subscribe' AND x <> 'publish')), ',') AS revoked, len(list_filter(string_split(permissions, ','), lambda x: x <> 'subscribe' AND x <> 'publish')) > 0 AS stays FROM grants")
def grant_and_revoke(read, spark):
    """Permissions after a grant, and after a revocation; a grant without any goes."""
    p = F.split("permissions", ",")
    left = F.array_except(p, F.array(F.lit("subscribe"), F.lit("publish")))
    return read("grants").select("realm", "role", "uri", F.array_join(F.array_sort(F.array_union(p, F.array(F.lit("call"), F.lit("cancel")))), ",").alias("granted"), F.array_join(F.array_sort(left), ",").alias("revoked"), (F.size(left) > 0).alias("stays"))


@query("role_names", "grants users", " SELECT realm, role_type || '/' || role AS qualified, uri, CASE WHEN uri = '*' THEN '' ELSE uri END AS resource, role_type = 'user' AND NOT EXISTS (SELECT 1 FROM users u WHERE u.realm = g.realm AND u.username = g.role) AS unknown FROM grants g")
def role_names(read, spark):
    known = read("users").select("realm", F.col("username").alias("role"), F.lit(True).alias("known"))
    g = read("grants").join(known, ["realm", "role"], "left")
    return g.select("realm", F.concat_ws("/", "role_type", "role").alias("qualified"), "uri", F.when(F.col("uri") == "*", "").otherwise(F.col("uri")).alias("resource"), ((F.col("role_type") == "user") & F.col("known").isNull()).alias("unknown"))


@query("inherited_properties", "realms", " SELECT r.realm, coalesce(r.sso, p.sso) AS sso FROM realms r LEFT JOIN realms p ON p.realm = r.prototype")
def inherited_properties(read, spark):
    p = read("realms").select(F.col("realm").alias("p"), F.col("sso").alias("p_sso"))
    return read("realms").join(p, F.col("prototype") == F.col("p"), "left").select("realm", F.coalesce("sso", "p_sso").alias("sso"))


@query("group_levels", "groups", f", n AS (SELECT realm || '/' || name AS node, {MEMBERS.format(x='member_of')} AS m, realm FROM groups), e AS (SELECT node, realm || '/' || unnest(m) AS needs FROM n), known AS (SELECT e.* FROM e JOIN n ON n.node = e.needs), lv AS (SELECT node, 0 AS level FROM n UNION SELECT k.node, lv.level + 1 FROM known k JOIN lv ON lv.node = k.needs) SELECT node, CAST(max(level) AS BIGINT) AS level FROM lv GROUP BY node")
def group_levels(read, spark):
    """Topological levels of groups; realms with prototypes are ordered in the same way."""
    nodes = read("groups").select(F.concat_ws("/", "realm", "name").alias("node"))
    edges = read("groups").select(F.concat_ws("/", "realm", "name").alias("node"), "realm", F.explode(A.listed("member_of")).alias("m")).select("node", F.concat_ws("/", "realm", "m").alias("needs"))
    return A.levels(edges.join(nodes.withColumnRenamed("node", "needs"), "needs").select("node", "needs"), nodes).select("node", F.col("level").cast("long").alias("level"))


@query("user_listing", "users", f" SELECT realm, username, array_to_string(list_sort(list_distinct(list_concat({MEMBERS.format(x='member_of')}, ['new']))), ',') AS added, array_to_string(list_filter({MEMBERS.format(x='member_of')}, lambda x: x <> 'staff'), ',') AS removed FROM users WHERE member_of <> 'alias'")
def user_listing(read, spark):
    """Users without aliases, with a group added and with one removed."""
    g = A.listed("member_of")
    return read("users").where("member_of <> 'alias'").select("realm", "username", F.array_join(F.array_sort(F.array_union(g, F.array(F.lit("new")))), ",").alias("added"), F.array_join(F.array_except(g, F.array(F.lit("staff"))), ",").alias("removed"))


@query("group_metadata", "realms groups users", closure_sql(f"{CLOSURE} SELECT realm, username, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, CASE WHEN count(DISTINCT origin) = 1 THEN min(origin) END AS single FROM member GROUP BY ALL"))
def group_metadata(read, spark):
    """Metadata of all groups of a user merged; a single value is unwrapped."""
    m = A.closure(spark, read("users"), A.resolved_groups(read("groups"), read("realms"))).groupBy("realm", "username").agg(F.array_sort(F.collect_set("origin")).alias("o"))
    return m.select("realm", "username", F.array_join("o", ",").alias("origins"), F.when(F.size("o") == 1, F.col("o")[0]).alias("single"))


ADDRESS = "list_reduce(list_transform(string_split({x}, '.'), lambda x: CAST(x AS BIGINT)), lambda a, x: a * 256 + x)"
IN_RANGE = f"""hits AS (SELECT conn, c.realm, c.username, s.username AS s_user, cidr, method, CAST(string_split(cidr, '/')[2] AS BIGINT) AS mask FROM connections c JOIN sources s ON s.realm = c.realm AND s.username IN ('all', c.username)
 AND {ADDRESS.format(x="ip")} >> (32 - CAST(string_split(cidr, '/')[2] AS INT)) = {ADDRESS.format(x="string_split(cidr, '/')[1]")} >> (32 - CAST(string_split(cidr, '/')[2] AS INT)))"""


@query("source_matches", "sources connections", f", {IN_RANGE} SELECT conn, cidr, method, row_number() OVER (PARTITION BY conn ORDER BY mask DESC, CASE WHEN s_user = 'all' THEN 1 ELSE 0 END, cidr) AS place FROM hits")
def source_matches(read, spark):
    """Sources that admit each connection, most specific first."""
    return A.matching_sources(read("connections"), read("sources")).select("conn", "cidr", "method", F.col("place").cast("long").alias("place"))


@query("first_source", "sources connections", f", {IN_RANGE} SELECT conn, cidr FROM (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY mask DESC) AS place FROM hits WHERE s_user <> 'all') x WHERE place = 1")
def first_source(read, spark):
    own = read("sources").where("username <> 'all'")
    return A.matching_sources(read("connections"), own).where("place = 1").select("conn", "cidr")


@query("cidr_parts", "sources", f" SELECT DISTINCT cidr, CAST(string_split(cidr, '/')[2] AS BIGINT) AS mask, ({ADDRESS.format(x="string_split(cidr, '/')[1]")} >> (32 - CAST(string_split(cidr, '/')[2] AS INT))) << (32 - CAST(string_split(cidr, '/')[2] AS INT)) AS net FROM sources")
def cidr_parts(read, spark):
    from ..functions import net

    return read("sources").select("cidr", net.mask_length(F.col("cidr")).cast("long").alias("mask")).distinct().withColumn("net", net.network(net.address(F.split("cidr", "/")[0]), F.col("mask")))


@query("auth_methods", "sources connections", f", offered AS (SELECT * FROM (VALUES ('shop', 'ticket', 1), ('shop', 'cryptosign', 2), ('shop', 'password', 3), ('lab', 'password', 1)) v(realm, method, rank)), {IN_RANGE} SELECT DISTINCT conn, h.method, rank FROM hits h JOIN offered o ON o.realm = h.realm AND o.method = h.method")
def auth_methods(read, spark):
    """Methods that a realm offers and a connection's sources allow: a natural join."""
    offered = spark.createDataFrame([("shop", "ticket", 1), ("shop", "cryptosign", 2), ("shop", "password", 3), ("lab", "password", 1)], "realm string, method string, rank int")
    return A.matching_sources(read("connections"), read("sources")).join(offered, ["realm", "method"]).select("conn", "method", "rank").distinct()
