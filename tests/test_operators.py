"""Laws, golden orders and brute-force comparisons for the engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from tramline import plans
from tramline.functions import cbor, hashing, msgpack, net, scalars, stamps, templates
from tramline.functions import uri as U
from tramline.operators import access, balance, events, patterns, registry, state
from tramline.sources import bridge, files


def brute(target, uri, policy):
    if policy == "exact":
        return target == uri
    if policy == "prefix":
        return target.encode().startswith(uri.encode())
    t, p = target.split("."), uri.split(".")
    return len(t) == len(p) and all((b == "" and a != "") or a == b != "" for a, b in zip(t, p))


def test_pattern_join_is_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 2)))
    targets = sorted({".".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)} | {"a..b", ""})
    entries = []
    for i in range(200):
        policy = rng.choice(["exact", "prefix", "wildcard"])
        c = [word() for _ in range(rng.randint(1, 4))]
        uri = ".".join("" if policy == "wildcard" and rng.random() < 0.4 else x for x in c)
        entries.append((i, "r", "" if policy == "prefix" and i % 9 == 0 else uri, policy))
    t = spark.createDataFrame([("r", x) for x in targets] + [("other", targets[0])], "realm string, topic string")
    e = spark.createDataFrame(entries, "entry_id int, realm string, uri string, policy string")
    joined = patterns.match_patterns(t, e)
    got = {(r.topic, r.entry_id) for r in joined.collect()}
    assert got == {(x, i) for x in targets for i, _, u, p in entries if brute(x, u, p)}
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    naive = t.where("realm = 'r'").crossJoin(e.drop("realm")).where(U.matches(F.col("topic"), F.col("uri"), F.col("policy")))
    assert {(r.topic, r.entry_id) for r in naive.collect()} == got


def test_golden_order(spark):
    golden = [("a1.b2.c3.d4.e55", "exact"), ("a1.b2.c3.d4", "prefix"), ("a1.b2.c3", "prefix"), ("a1.b2.c33..e5", "wildcard"), ("a1.b2..d4.e5", "wildcard"), ("a1.b2..d4.", "wildcard"), ("a1.b2...e5", "wildcard"), ("a1...d4.e5", "wildcard"), ("a1....e5", "wildcard"), ("a1....", "wildcard")]
    mixed = random.Random(2).sample(golden, len(golden))
    df = spark.createDataFrame([(i, u, p, "single", "n", 0) for i, (u, p) in enumerate(mixed)], "entry_id int, uri string, policy string, invoke string, node string, created_ms long")
    assert [(r.uri, r.policy) for r in df.orderBy(*patterns.ranking()).collect()] == golden
    assert spark.range(1).select(U.degree(F.lit("a1.b2..d4"))).first()[0] == 13


def test_jump_hash_vectors():
    for want, key, n in [(0, 0, 1), (0, 3, 1), (0, 0, 2), (1, 4, 2), (0, 7, 2), (55, 1, 128), (120, 129, 128), (0, 0, 100000000), (38172097, 128, 100000000), (1644467860, 128, 2147483648), (92, 18446744073709551615, 128)]:
        assert hashing.jump(key, n) == want


def test_lww_take_and_page(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 3, "c", False), (1, 2, "b", False), (2, 1, "x", False), (2, 2, None, True)], "k int, version int, v string, deleted boolean")
    assert [(r.k, r.v) for r in registry.latest(log, ["k"], ["version"]).collect()] == [(1, "c")]
    taken, left = registry.take(log, log.where("k = 1"), ["k"])
    assert taken.count() == 3 and left.count() == 2
    rows, after = [], None
    while page := registry.page(log.select("k", "version"), ["k", "version"], 2, after).collect():
        rows += [tuple(r) for r in page]
        after = tuple(page[-1])
    assert rows == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_access_laws(spark):
    realms = spark.createDataFrame([("base", None), ("shop", "base")], "realm string, prototype string")
    groups = spark.createDataFrame([("base", "g", "h"), ("base", "h", "g"), ("shop", "g", "")], "realm string, name string, member_of string")
    users = spark.createDataFrame([("shop", "ann", "g"), ("base", "bob", "g")], "realm string, username string, member_of string")
    member = {(r.username, r.name, r.origin) for r in access.closure(spark, users, access.resolved_groups(groups, realms)).collect()}
    assert member == {("ann", "g", "shop"), ("bob", "g", "base"), ("bob", "h", "base")}  # an own group hides the prototype's; a cycle ends
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "node string, needs string")
    assert {(r.node, r.level) for r in access.levels(edges, nodes).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    with pytest.raises(ValueError):
        access.levels(edges.union(spark.createDataFrame([("c", "a")], "node string, needs string")), nodes)


def test_cidr(spark):
    df = spark.createDataFrame([("10.1.2.3", "10.1.0.0/16"), ("10.2.2.3", "10.1.0.0/16"), ("2001:db8::1", "2001:db8::/32"), ("x", "10.0.0.0/8")], "ip string, cidr string")
    assert [r[0] for r in df.select(net.in_range("ip", "cidr")).collect()] == [True, False, True, False]
    one = df.select(net.address(F.lit("256.1.1.1")), net.mask_length(F.lit("1.2.3.4/33")), net.network(net.address(F.lit("10.1.2.3")), F.lit(8))).first()
    assert tuple(one) == (None, None, 10 << 24)


def test_token_bucket_and_queue(spark):
    asked = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 10, 1010, 1011])], "key string, ts_ms long, n int")
    got = state.token_bucket(asked, "key", 1, 1 / 1000, ["ts_ms", "n"]).orderBy("n").collect()
    assert [r.allowed for r in got] == [True, False, True, False] and got[1].resets_in_ms == 1000
    q = spark.createDataFrame([("q", i, 10) for i in range(10)], "q string, seq int, size int")
    assert sorted(r.seq for r in state.bounded_queue(q, "q", "seq", "size", 5, 35).collect()) == [7, 8, 9]


def test_retained_lists(spark):
    empty = F.expr("cast(array() as array<int>)")
    r = spark.range(1).select(state.deliverable(F.lit(1), empty, empty), state.deliverable(F.lit(1), empty, empty, True), state.deliverable(F.lit(1), F.lit(None).cast("array<int>"), empty, True), state.live(F.lit(0), 5), state.live(F.lit(5), 5)).first()
    assert tuple(r) == (True, False, True, True, False)


CBOR = [(0, "00"), (23, "17"), (24, "1818"), (1000000, "1a000f4240"), (18446744073709551615, "1bffffffffffffffff"), (18446744073709551616, "c249010000000000000000"), (-1, "20"), (-18446744073709551617, "c349010000000000000000"), (1.5, "f93e00"), (100000.0, "fa47c35000"), (1.1, "fb3ff199999999999a"), (float("inf"), "f97c00"), (False, "f4"), (None, "f6"), (b"\x01\x02", "420102"), ("ü", "62c3bc"), ([1, [2, 3]], "8201820203"), ({"a": 1, "b": [2, 3]}, "a26161016162820203"), (cbor.Tag(1, 1363896240), "c11a514b67b0"), ({"key": [1, 2, 3]}, "a1636b657983010203")]


@pytest.mark.parametrize("value,text", CBOR)
def test_cbor_vectors(value, text):
    assert cbor.encode(value, deterministic=True).hex() == text
    assert cbor.decode(bytes.fromhex(text)) == value


def test_cbor_more():
    assert cbor.decode(bytes.fromhex("9f0182029fff0304ff")) == [1, [2, []], 3, 4]
    assert cbor.decode(bytes.fromhex("5f42010243030405ff")) == b"\x01\x02\x03\x04\x05"
    assert cbor.encode({"b": 1, "a": 2}, True) == cbor.encode({"a": 2, "b": 1}, True)
    head, tail = cbor.decode_head(cbor.encode([16, 7, {"x": 1}, "rest"]), 2)
    assert head == [16, 7] and tail == cbor.encode({"x": 1}) + cbor.encode("rest")
    for broken in ("18", "ff", "8201", "1c"):
        with pytest.raises(ValueError):
            cbor.decode(bytes.fromhex(broken))


def test_templates(spark):
    context = F.lit('{"a":{"k":"v","m":{"x":"1"}},"s":"c","n":"12.7","codes":{"c":"5"}}')
    of = lambda t: spark.range(1).select(templates.compiled(t, context)).first()[0]
    assert of("{{a.k}}/{{missing}}-{{s}}") == "v/-c"
    assert of("{{codes |> get({{s}}, 500) |> integer}}") == "5" and of("{{codes |> get(zz, 500) |> integer}}") == "500"
    assert of("{{a.m |> put(y, {{s}})}}") == '{"x":"1","y":"c"}'
    assert templates.resolved({"variables": {"x": "1", "y": "{{variables.x}}2"}, "u": "/{{variables.y}}", "in": {"variables": {"x": "9"}, "v": "{{variables.x}}"}}) == {"u": "/12", "in": {"v": "9"}}


def test_causal_stamps():
    a, b = stamps.fork(stamps.SEED)
    a1 = stamps.event(a)
    assert stamps.leq(a[1], a1[1]) and not stamps.leq(a1[1], a[1])
    b1 = stamps.event(stamps.event(b))
    assert not stamps.leq(a1[1], b1[1]) and not stamps.leq(b1[1], a1[1])
    j = stamps.join(a1, b1)
    assert stamps.leq(a1[1], j[1]) and stamps.leq(b1[1], j[1]) and j[0] == 1


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.joined(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), scalars.joined(F.array(F.lit("a"))), scalars.normal_name(F.lit("Straße ﬁ")), scalars.fnv1a(F.lit("a")), scalars.base62(F.lit(3843)),
        scalars.error_status(F.lit("wamp.error.no_such_procedure")), scalars.form_body(F.create_map(F.lit("b"), F.lit("x y"), F.lit("a"), F.lit("&"))), scalars.uuid7_valid(scalars.uuid7(F.lit(1700000000000), F.lit(1))),
    ).first()
    assert tuple(r) == ("'a', 'b' and 'c'", "'a'", "strasse fi", 0xE40C292C, "zz", 501, "a=%26&b=x+y", True)


def test_backup_and_specs(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, version int, v string")
    files.back_up({"users": t, "registration": t}, str(tmp_path / "b"))
    current = spark.createDataFrame([(1, 2, "new")], "k int, version int, v string")
    merged, counts = files.restore(spark, str(tmp_path / "b"), "users", current, ["k"], ["version"])
    assert sorted((r.k, r.v) for r in merged.collect()) == [(1, "new"), (2, "b")] and tuple(counts.first()) == (2, 2)
    assert not (tmp_path / "b" / "registration").exists()
    (tmp_path / "s.json").write_text('[{"id":"1","topic":"t"},{"id":"1","topic":"t"},{"id":"2"}]')
    assert files.specs(spark, str(tmp_path / "s.json"), "id string, topic string").count() == 1


def test_retries():
    calls = []

    def flaky(df, batch):
        calls.append(batch)
        if len(calls) < 3:
            raise OSError
        return "done"

    waits = []
    assert files.retried(flaky, sleep=waits.append)(None, 7) == "done" and waits == [0.05, 0.1]
    with pytest.raises(OSError):
        files.retried(lambda d, b: (_ for _ in ()).throw(OSError()), most=1, sleep=waits.append)(None, 1)


@pytest.mark.parametrize("value,text", [(0, "00"), (127, "7f"), (128, "cc80"), (65536, "ce00010000"), (-1, "ff"), (-33, "d0df"), (-32769, "d2ffff7fff"), (2**64 - 1, "cfffffffffffffffff"), (1.5, "cb3ff8000000000000"), (None, "c0"), (True, "c3"), ("é", "a2c3a9"), (b"\x01", "c40101"), ([1, "a"], "9201a161"), ({"k": []}, "81a16b90"), ("x" * 40, "d928" + "78" * 40), (list(range(20)), "dc0014" + "".join(f"{i:02x}" for i in range(20)))])
def test_msgpack_vectors(value, text):
    assert msgpack.encode(value).hex() == text and msgpack.decode(bytes.fromhex(text)) == value
    head, tail = msgpack.decode_head(msgpack.encode([16, 7, {"x": 1}, value]), 2)
    assert head == [16, 7] and tail == msgpack.encode({"x": 1}) + msgpack.encode(value)


def test_msgpack_broken():
    for broken in ("cc", "a561", "92", "c1", "0000"):
        with pytest.raises(ValueError):
            msgpack.decode(bytes.fromhex(broken))
    with pytest.raises(ValueError):
        msgpack.encode(2**64)


def test_long_patterns(spark):
    wild = ".".join(["", *(f"c{i}" for i in range(79))])
    t = spark.createDataFrame([("r", ".".join(f"c{i}" for i in range(-1, 79)))], "realm string, topic string")
    e = spark.createDataFrame([("r", wild, "wildcard", 1), ("r", wild + ".x", "wildcard", 2)], "realm string, uri string, policy string, id int")
    assert [r.id for r in patterns.match_patterns(t, e).collect()] == [1]
    assert [r.uri for r in e.orderBy(*[c.desc() for c in U.degree_keys(F.col("uri"))]).collect()] == [wild + ".x", wild]


def test_ipv6_ranges(spark):
    import ipaddress

    rng = random.Random(5)
    ips = [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 64, 100]))) for _ in range(30)] + ["::", "::1", "1::", "x", "1:2", "1::2::3"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    for cidr in ("::/64", "::/0", "2001:db8::/32", "::/128"):
        got = [r[0] for r in df.select(net.in_range6(F.col("ip"), cidr)).collect()]
        valid = lambda x: all(c in "0123456789abcdef:" for c in x) and x not in ("1:2", "1::2::3")
        assert got == [valid(x) and ipaddress.ip_address(x) in ipaddress.ip_network(cidr) for x in ips]


def test_running(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i, i % 7) for i in range(200)], "k string, i int, v int")
    got = {(r.k, r.i): r.s for r in registry.running(df, ["k"], [(F.expr("i div 16"), True)], [F.col("i").desc()], F.col("v"), "s").collect()}
    assert got == {(k, i): sum(j % 7 for j in range(i, 200) if (j % 3 == 0) == (i % 3 == 0)) for i in range(200) for k in ["a" if i % 3 else None]}


def test_event_bus_and_callbacks(spark):
    bus, seen = events.Bus(), []
    bus.add("bad", F.lit(True), lambda df, b: (_ for _ in ()).throw(OSError("down")))
    bus.add("odd", F.col("id") % 2 == 1, lambda df, b: seen.append(df.count()))
    with pytest.raises(RuntimeError, match="bad: down"):
        bus.sink(spark.range(5), 0)
    assert seen == [2]
    with pytest.raises(ValueError):
        events.Callbacks().register("f", lambda x: x, 2)
    shed = events.shed(spark.range(10), 3, F.expr("id div 5"), ["id"]).where("pooled")
    assert sorted(r.id for r in shed.collect()) == [0, 1, 2, 5, 6, 7]


def test_bridge(spark, tmp_path):
    spark.dataSource.register(bridge.BridgeSource)
    spark.range(6).write.format("tramline_bridge").option("plugin", "plugin:ToFile").option("folder", str(tmp_path)).mode("append").save()
    assert sorted(int(x) for f in tmp_path.iterdir() for x in f.read_text().split()) == [0, 2, 4]


def test_error_statuses(spark):
    want = {"wamp.error.no_such_subscription": 502, "wamp.error.option_not_allowed": 400, "wamp.error.procedure_already_exists": 400, "tramline.error.bad_gateway": 503, "tramline.error.timeout": 504, "wamp.error.not_authorized": 401, "wamp.error.authorization_failed": 403, "wamp.close.close_realm": 500}
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", scalars.error_status(F.col("u")).alias("s")).collect()
    assert {r.u: r.s for r in got} == want


def build_sides(plan):
    """The sides that a plan's joins broadcast, as the nodes in them."""
    nodes = lambda p: [p.nodeName(), *(n for i in range(p.children().size()) for n in nodes(p.children().apply(i)))]
    mine = [nodes(plan.left() if str(plan.buildSide()) == "BuildLeft" else plan.right())] if "BroadcastHashJoin" in plan.nodeName() else []
    return mine + [n for i in range(plan.children().size()) for n in build_sides(plan.children().apply(i))]


def test_authorized_broadcasts_no_requests(spark, tmp_path):
    spark.createDataFrame([("r", f"u{i}") for i in range(50)], "realm string, username string").write.parquet(str(tmp_path / "users"))
    users = spark.read.parquet(str(tmp_path / "users"))
    both = lambda x: F.explode(F.array(*map(F.lit, x)))
    requests = users.select("*", both(["call", "publish"]).alias("permission")).select("*", both(["com.a", "com.b.c", "org"]).alias("resource"))
    held = [("r", "u1", "com", "prefix", "call"), ("r", "u1", "com", "prefix", "call"), ("r", "u2", "com..c", "wildcard", "publish"), ("r", "u3", "org", "exact", "call")]
    grants = spark.createDataFrame(held, "realm string, username string, uri string, policy string, permission string")
    out = access.authorized(requests.unionAll(requests), grants)
    allowed = [(r.username, r.permission, r.resource) for r in out.where("allowed").collect()]
    assert sorted(allowed) == sorted(2 * [("u1", "call", "com.a"), ("u1", "call", "com.b.c"), ("u2", "publish", "com.b.c"), ("u3", "call", "org")]) and out.count() == 600
    assert not any("Generate" in n for side in build_sides(out._jdf.queryExecution().sparkPlan()) for n in side)


def test_best_entries_stand_for_all(spark):
    rng = random.Random(5)
    made = [("r", rng.choice([("a.b", "exact"), ("a", "prefix"), ("a.", "prefix"), (".b", "wildcard"), ("a.", "wildcard")]), rng.choice(["single", "first", "random"]), f"node{rng.randint(0, 2)}", rng.randint(0, 3), i) for i in range(200)]
    entries = spark.createDataFrame([(r, u, p, v, n, c, i) for r, (u, p), v, n, c, i in made], "realm string, uri string, policy string, invoke string, node string, created_ms long, entry_id int")
    targets = spark.createDataFrame([("r", t) for t in ("a.b", "a.c", "c.b", "abc", "z")], "realm string, topic string")
    for node in (None, "node1"):
        few = patterns.best_entries(entries, node)
        best = lambda e: sorted((r.topic, r.entry_id) for r in patterns.best_match(patterns.match_patterns(targets, e), ["realm", "topic"], node).collect())  # noqa: E731, B023
        assert few.count() == 5 and few.columns == entries.columns
        assert best(few) == best(entries)


@pytest.mark.parametrize("name", ["best_registration", "best_local_registration", "call_routing"])
def test_best_meets_one_entry_of_a_pattern(spark, name, monkeypatch):
    met = []
    match = patterns.match_patterns
    monkeypatch.setattr(patterns, "match_patterns", lambda t, p, *a, **k: met.append(p) or match(t, p, *a, **k))
    plans.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert met[0].count() == met[0].select("realm", "uri", "policy").distinct().count()


def test_index_of_is_selected(spark):
    names = [s for s in balance.STRATEGIES if s != "least_loaded_sample"]
    rows = [("r", s, s, 10 * (i % 3) + (s == "last"), i, (i * 5) % 4) for s in names for i in range(7)]
    entries = spark.createDataFrame(rows, "realm string, uri string, invoke string, created_ms long, entry_id long, queued long")
    calls = spark.createDataFrame([("r", s, t) for s in names for t in range(1, 20)], "realm string, uri string, turn long")
    key, (turn, draw) = ["realm", "uri"], (F.col("turn"), F.col("turn") * 7919)
    of = balance.numbered(entries, key, [(F.expr("created_ms div 10"), False)], [F.col("created_ms"), F.col("entry_id")])
    at = balance.index_of(F.col("invoke"), F.col("n"), turn, draw, turn, F.col("least"))
    got = calls.join(balance.indexed(of, key), key).withColumn("at", at).join(of.select(*key, "at", "entry_id"), [*key, "at"]).select("uri", "turn", "entry_id")
    lists = entries.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("created_ms", "entry_id", "queued", "invoke"))).alias("c"))
    want = calls.join(lists, key).select("uri", "turn", balance.selected(F.col("c"), F.col("c")[0]["invoke"], turn, draw, turn, turn)["entry_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 19 * len(names)


@pytest.mark.parametrize("name", ["consistent_hash_callee", "selected_callee"])
def test_no_list_of_callees_goes_to_python(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    found = []

    def walk(p):
        found.extend([p] if p.nodeName() == "ArrowEvalPython" else [])
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    assert found and not any("array" in p.child().schema().simpleString() for p in found)
