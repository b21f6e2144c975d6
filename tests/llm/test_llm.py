"""The training-data operators against brute force, round trips and held-out likelihood, with odd and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tramline.llm import bpe, graph, html, jaccard, language_model, neighbours, packing, quality, queries, sharding, substring, tokencount
from tramline.llm.words import WordHashes


def texts(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def test_sharding(spark, docs, odd, empty):
    for df in (docs, odd):
        out = sharding.shard_rows(df, 5).collect()
        n = df.count()
        assert sorted(r.place for r in out) == list(range(n)) == sorted(r.row for r in out)
        sizes = Counter(r.shard for r in out)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(k)) for s, k in sizes.items())
        key = lambda d, t: (d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8)
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in out) == sorted(key(r.doc_id, r.text) for r in df.collect())
    again = sharding.shard_rows(docs.repartition(7), 5).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(docs, 5).collect())
    assert sharding.shard_rows(empty).count() == 0
    for n in (1, 2, 3, 7, 50, 1000):
        side = math.ceil(math.sqrt(n))
        places = spark.range(n).select(F.expr(sharding.permuted("id", f"{n}L", f"{side}L", f"{-(-n // side)}L", 7))).collect()
        assert sorted(r[0] for r in places) == list(range(n))


def test_bpe(docs, odd, empty):
    enc = bpe.encoding(bpe.RANKS)
    for df in (docs, odd):
        out = bpe.decode_ids(bpe.encode_texts(df)).collect()
        want = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
        got = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in out), key=str)
        assert got == want
        whole = {(r.doc_id, t): enc.encode_ordinary(t) for r in df.collect() for t in [r.text or ""]}
        assert all(np.frombuffer(r.ids, "<u4").tolist() == whole[r.doc_id, bytes(r.decoded).decode()] and r.n_tokens == len(r.ids) // 4 for r in out)
    assert bpe.encode_texts(empty).count() == 0
    text = "it's 12  \n\n a\x1cb  ümläut...   'll " * 40
    for size in (1, 7, 50):
        assert "".join(bpe.chunks(text, size)) == text
        assert [i for c in bpe.chunks(text, size) for i in enc.encode_ordinary(c)] == enc.encode_ordinary(text)


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.VOCABULARY)
    for df in (docs, odd):
        out = packing.pack_documents(df, window=64).collect()
        want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in df.collect())
        sequences = {}
        for r in out:
            sequences.setdefault(r.sequence_id, []).append(r)
        total = waste = 0
        for s in sequences.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
            n = sum(r.length for r in s)
            assert n <= 64
            total, waste = total + n, waste + (0 if n & (n - 1) == 0 else 64 - n)
        assert waste < 0.25 * total
        # pieces joined in order of the rows are the documents
        got, open_docs = Counter(), []
        for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
            ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
            if r.start == 0:
                open_docs.append([r.doc_id, r.doc_tokens, ()])
            assert open_docs[-1][0] == r.doc_id and len(open_docs[-1][2]) == r.start
            open_docs[-1][2] += ids
        for d, n, ids in open_docs:
            assert len(ids) == n
            got[d, ids] += 1
        assert got == want
    assert packing.pack_documents(empty).count() == 0


def test_packing_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        at = sorted({0, *rng.integers(1, 60, 20).tolist(), 60})
        cost = [0, *rng.integers(0, 9, len(at) - 1).tolist()]
        window = max(10, max(b - a for a, b in zip(at, at[1:])))
        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + window - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= window)
        path = packing.cuts(at, cost, window)
        assert path[0] == 0 and path[-1] == len(at) - 1
        assert sum(window - (at[b] - at[a]) + cost[b] for a, b in zip(path, path[1:])) == best[-1]


def test_packing_cuts_at_boundaries():
    """Windows end at documents and sentences; elsewhere only in stretches longer than a window without either."""
    sentence = np.zeros(10, bool)
    sentence[2] = True
    rng, packer, pieces = np.random.default_rng(6), packing.Packer(sentence, window=64), []
    docs = [np.array(([5] * int(rng.integers(8, 30)) + [2]) * 4, np.uint32) for _ in range(200)]
    docs[100] = np.full(300, 5, np.uint32)
    for i, ids in enumerate(docs):
        pieces += packer.add(i, ids)
    pieces += packer.drain(True)
    last = {}
    for d, start, ids, total, sequence, _ in pieces:
        last[sequence] = (d, start + len(ids) // 4 == total or bool(sentence[np.frombuffer(ids, "<u4")[-1]]))
    ends = [last[s] for s in sorted(last)]
    inside = [d for d, boundary in ends[:-6] if not boundary]  # the last window is cut into at most six powers of two
    assert set(inside) == {100} and len(inside) in (4, 5)


def test_substring(docs, odd, empty, monkeypatch):
    rows = texts(docs)
    first, want = {}, {}
    for d, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = [True] * 50
        want[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    assert sum(g for _, g, _ in want.values()) > 500
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    for common, long_gram in ((400, 40), (1, 40)):  # the second treats all anchors as crowded
        monkeypatch.setattr(substring, "COMMON", common)
        got = {r.doc_id: tuple(r)[1:] for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", digest).collect()}
        assert got == want
    out = substring.remove_repeats(odd, keep=("id", "doc")).collect()
    assert len(out) == odd.count() and all(r.n_removed == 0 for r in out) and {r.rest.doc for r in out} == {"b"}
    assert substring.remove_repeats(empty).count() == 0


def test_automaton():
    a = substring.SuffixAutomaton()
    for text in (b"a b c a b d", b"x b c y"):
        a.add(text.split())
    assert a.spans(b"z a b c a q b d x b c y".split(), 2) == [(1, 5), (6, 12)]  # spans that touch are one
    assert a.spans(b"d x".split(), 2) == []


def brute_groups(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("percent,words,limit", [(90, 3, 1000), (80, 5, 1000), (90, 3, 1), (60, 1, 2)])
def test_jaccard(docs, monkeypatch, percent, words, limit):
    monkeypatch.setattr(jaccard, "LIMIT", limit)  # a small limit sends regions through the distributed cut
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, percent=percent, words=words).collect()}
    assert got == brute_groups(texts(docs), words, percent)


def test_jaccard_odd(odd, empty):
    got = jaccard.similar_groups(odd).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(None, None): 2, (1, 1): 2, (2, 2): 2, (3, 1): 1})
    assert jaccard.similar_groups(empty).count() == 0


def test_region_join():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 10**6, 60).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.append(b[rng.random(len(b)) > 0.03], rng.integers(0, 10**6, 2).astype(np.uint64))) for b in base for _ in range(20)]
    forest = jaccard.Forest(len(sets))
    jaccard.join_region(jaccard.Index(sets), list(range(len(sets))), forest, 90)
    want = jaccard.Forest(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both * 100 >= 90 * (len(a) + len(b) - both):
                want.join(i, j)
    assert all((forest.root(i) == forest.root(j)) == (want.root(i) == want.root(j)) for i in range(len(sets)) for j in range(i))


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (95, 100), (7, 7)], "hi long, lo long")
    assert {r.node: r.root for r in graph.components(links).collect()} == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:140] = v[0]  # ties
    rows = [(i, [float(y) for y in x], 1) for i, x in enumerate(v)]
    odd = [(600, None, 1), (620, [0.0] * 16, 1), (640, [1.0] * 15 + [None], 1), (660, [1.0] * 15 + [float("nan")], 1), (680, [1.0] * 3, 1), (None, [1.0] * 16, 1), (0, rows[0][1], 1)]
    out = neighbours.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, entry int")).collect()
    hit = total = 0
    for q in range(0, 600, 20):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        s = (v.astype(float) * v[q].astype(float)).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        hit, total = hit + len({r.vec_id for r in own} & set(best.tolist())), total + 20
        assert [r.rank for r in own] == list(range(1, 21)) and all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert hit >= 0.9 * total and {r.query_id for r in out} == set(range(0, 600, 20))
    few = neighbours.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, x int")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Repeated rows take no places among the least ids of equal vectors: tied queries get exactly the least other ids."""
    v = np.random.default_rng(9).normal(size=(90, 16)).astype(np.float32)
    v[40:81] = 4 * v[0]  # 41 ties, ahead of all others
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] * 2 + [(40, [float(y) for y in v[40]])] * 25
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    for q in (40, 60, 80):
        own = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert own == [i for i in range(40, 81) if i != q][:20]


def test_quality(docs, odd, empty):
    def brute(t):
        b = t.encode()
        w = b.split()
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in b.split(b"\n") if x.split()]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)

    got = quality.judge(docs, keep=("source",)).collect()
    by_id = dict(texts(docs))
    for r in got:
        f = brute(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 20 or 100 * f[4] > 30 * f[0]) and r.kept == (not r.base_failed and r.p_good >= 0.5)
    assert {r.source for r in got} == {"s", None}
    assert sorted(x for x in (r.n_words for r in quality.judge(odd).collect())) == [0, 0, 1, 5, 5, 5, 120]
    assert quality.judge(empty).count() == 0


def test_label_model():
    rng = np.random.default_rng(6)
    good = rng.random(20000) < 0.85
    votes = np.full((20000, 6), 1)
    for j, (miss, false) in enumerate([(0.7, 0.01), (0.6, 0.02), (0.8, 0.005), (0.7, 0.01), (0.9, 0.02), (0.5, 0.01)]):
        votes[:, j] = np.where(good, rng.random(20000) >= false, rng.random(20000) < miss)
        votes[rng.random(20000) < 0.2, j] = -1
    p, chances, share = quality.label_model(votes, np.ones(20000))
    seen = (votes == 0).any(1)
    assert ((p >= 0.5) == good).mean() > 0.93 and (p[~seen] > 0.5).all() and 0.75 < share < 0.95 and (chances[1] > chances[0]).all()


def test_language_model(spark, docs, odd, empty, monkeypatch):
    def base(df):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in df.collect()]
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        c = Counter(w for d, ws in rows if not held(d) for w in ws)
        n, v = sum(c.values()), len(c)
        return sorted(((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), n, pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))) for d, ws in rows), key=lambda r: r[:4])

    for head, modelled in ((200_000, 4096), (50, 30), (100, 4096)):  # the others join rare words' counts
        monkeypatch.setattr(language_model, "HEAD", head)
        monkeypatch.setattr(language_model, "WORDS", modelled)
        for df in (docs, odd):
            out = language_model.score_documents(df).collect()
            assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=lambda r: r[:4]) == base(df)
            assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert language_model.score_documents(empty).count() == 0


def test_language_model_tells_rare_words_apart(spark, monkeypatch):
    """Words beyond WORDS are told apart by the model, also those beyond HEAD, and ever more of them in larger corpora."""
    monkeypatch.setattr(language_model, "WORDS", 12)
    for head in (200_000, 20):
        monkeypatch.setattr(language_model, "HEAD", head)
        rows = [(i, " ".join(f"c{k}" for k in range(10)) + f" a{i % 40} b{i % 40}") for i in range(800)]
        tested = [(1000 + k, f"a{k} b{k}") for k in range(40)]
        out = language_model.score_documents(spark.createDataFrame(rows + tested, "doc_id long, text string")).collect()
        scores = [r.score for r in out if r.doc_id >= 1000]
        assert len(scores) == 40 and len({round(x, 4) for x in scores}) > 10
    sizes = [language_model.buckets(10**k) for k in range(9)]
    assert sizes[0] == 1 and sizes == sorted(set(sizes)) and language_model.buckets(0) == 1


def test_language_model_learns():
    """Gradients by differences, one probability for all words, equal scores in any company, and context that is used."""
    weights = np.array([50.0, 30, 20, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
    m = language_model.Model(weights).start(weights)
    h = np.random.default_rng(0).normal(size=(1, language_model.STATE)).astype(np.float32)
    total = sum(math.exp(m.outputs(h, np.array([i]))[0][0]) for i in range(len(weights)))
    assert total == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(1)
    lines = [np.array([*(rng.choice([2, 3] if k % 2 else [4, 5], 30)), 0], np.int32) for k in range(400)]  # two languages
    squares = np.full(m.size, 1e-4, np.float32)
    held = [np.array([2, 3] * 15 + [0], np.int32), np.array([4, 5] * 15 + [0], np.int32)]
    before = m.score(held)
    for _ in range(3):
        m.learn(np.concatenate(lines), language_model.starts(lines), squares)
    after = m.score(held)
    assert (after > before + 10).all()
    both, alone = m.score(held + lines), m.score(held[:1])
    assert both[0] == pytest.approx(alone[0], rel=1e-4)
    long = np.concatenate([lines[0][:-1]] * 200)
    assert m.score([long, lines[1]])[0] == pytest.approx(m.score([long])[0], rel=1e-4)


def test_gradient(monkeypatch):
    weights = np.array([5.0, 4, 3, 2, 1, 1, 1, 1])
    tokens = np.random.default_rng(2).integers(0, 8, 64).astype(np.int32)
    fresh = np.arange(64) % 8 == 0  # eight lanes, a document each
    monkeypatch.setattr(language_model, "STEPS", 8)
    m = language_model.Model(weights).start(weights)
    m.flat += np.random.default_rng(3).normal(0, 0.3, m.size).astype(np.float32)

    def loss(flat):
        x = language_model.Model(weights, flat)
        return -x.score(list(tokens.reshape(8, 8))).sum() / 64

    start = m.flat.copy()
    base = language_model.Model(weights, start)
    sums = np.full(m.size, 1e-30, np.float32)
    base.learn(tokens, fresh, sums)  # with sums near zero each step is RATE times the sign of the gradient
    step = (start - base.flat) / language_model.RATE
    rng = np.random.default_rng(4)
    checked = 0
    for i in rng.choice(m.size, 150, replace=False):
        e = np.zeros(m.size, np.float32)
        e[i] = 2e-2
        slope = (loss(start + e) - loss(start - e)) / 4e-2
        if abs(slope) > 2e-3 and np.isfinite(step[i]):
            checked += 1
            assert np.sign(slope) == np.sign(step[i])
    assert checked > 10


def test_html(spark):
    page = """<!doctype html><title>x</title><h1>Head &amp; tail</h1><p>one<p>two <b>bold</b>
 text<ul><li>a<li>b</ul><ol start=3><li>c</ol><table><caption>Cap</caption><tr><th>Name<th>N<tr><td>Alpha<td>1<tr><td colspan=2>wide cell<tr><td>x<br>y<td>22</table><div hidden>no</div><span style="display: none">no</span>end<pre>
 a
  b</pre><script>var t="</p>";</script>after<!-- c --> z"""
    want = "Head & tail\n\none\n\ntwo bold text\n\n* a\n* b\n\n3. c\n\nCap\nName   N\nAlpha  1\nwide cell\nx      22\ny\n\nend\n\n a\n  b\n\nafter z"
    assert html.visible_text(page) == want
    for broken in ("", "<", "<p", "<a href='x", "<script>x", "<!--", "</p></div>", "<table><td><table><tr>x", "<div>" * 3000 + "deep", "a < b & c &nosuch; <3"):
        assert isinstance(html.visible_text(broken), str)
    assert html.visible_text("a < b &amp; c <3") == "a < b & c <3" and html.visible_text("<div>" * 3000 + "deep") == "deep"
    df = spark.createDataFrame([(1, "<p>x", "u"), (None, None, "u"), (1, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in html.extract_text(df).collect()) == [("1", "x"), ("1", "x"), ("None", "")]
    assert html.extract_text(df.limit(0)).count() == 0


def test_html_colgroup_without_its_end():
    for row in ("<tr><td>x", "<tbody><tr><th>x", "<thead><tr><td>x", "<tfoot><tr><td>x", "<colgroup><col><tr><td>x"):
        assert html.visible_text(f"<table><colgroup><col><col>{row}<td>y</table>z") == "x  y\n\nz"
    assert html.visible_text("<table><colgroup><col><caption>c</caption><tr><td>x</table>") == "c\nx"
    assert html.visible_text("<table><colgroup> <col> lost? <tr><td>x</table>") == "lost?\nx"


def test_html_rowspan():
    page = "<table><tr><th>Name<th>N<th>M<tr><td rowspan=2>Alpha<td>1<td rowspan=0>all<tr><td>2<tr><td>B<td>3<tbody><tr><td>C<td>4<td>5</table>"
    assert html.visible_text(page) == "Name   N  M\nAlpha  1  all\n       2\nB      3\nC      4  5"


def test_html_text_in_row():
    assert html.visible_text("<table><tr>note<td>x <td>y</tr> more </table>") == "note\nmore\nx  y"


def test_token_counts(docs, odd, empty):
    pieces = tokencount.vocabulary(tokencount.MODEL)
    known, automaton = set(pieces), tokencount.Automaton(pieces)

    def brute(word):
        s, n = tokencount.FIRST + word, 0
        while s:
            fit = next((k for k in range(len(s), 0, -1) if s[:k] in known and s.startswith(tokencount.FIRST) == (n == 0)), 0)
            if not fit:
                return 1
            s, n = s[fit:], n + 1
        return n

    words = {w for _, t in texts(docs) for w in t.split()} | {"unbelievable", "日本語", "x" * 500, "ก\U0001f600", "2024-01-01"}
    assert all(automaton.count(w) == brute(w) for w in words) and automaton.count("") == 0
    small = tokencount.Automaton(["▁a", "▁ab", "▁abcd", "b", "c", "cd", "bcx"])
    assert [small.count(w) for w in ("ab", "abc", "abcd", "abcdc", "abcx", "q")] == [1, 2, 1, 2, 1, 1]
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs).collect()}
    counts = tokencount.Counts(automaton)
    assert got == {d: sum(counts[w] for w in t.encode().split()) for d, t in texts(docs)}
    assert tokencount.count_tokens(odd).count() == odd.count() and tokencount.count_tokens(empty).count() == 0


def test_queries_are_registered():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))
    assert public_tokenizers.path("x").startswith("/")
    assert jaccard.shingle_sets([b"", b"A b", b"a B c", b"a b c d"], WordHashes())[1].size == 1


def test_pipeline(spark, docs, empty):
    import corpus_pipeline as c

    rows = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        out = stage(spark, kept, None)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        after = {r.doc_id for r in out.collect()}
        if name == "ngram_jaccard":
            groups = brute_groups(texts(kept), c.SHINGLE, c.PERCENT)
            assert after == {d for d, (_, g) in groups.items() if g == d}
        assert after <= before
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert all(len(r.text) <= len(rows[r.doc_id].text) for r in kept.collect())
    pieces = c.STAGES[-1][1](spark, kept, None)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, empty, None).count() == 0
