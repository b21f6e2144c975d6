"""Hard inputs: long runs of white space, ties, several blocks, hot keys, odd rows through the whole pipeline."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import bpe, graph, html, jaccard, language_model, neighbours, packing, sql, store, substring


def piecewise(enc, text):
    """Ids of each match of the pattern, by a matcher that doesn't recurse."""
    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in enc._core_bpe.encode_single_piece(m[0].encode())]


@pytest.mark.parametrize("run", [" ", "\n", "\t", " 　\r"])
@pytest.mark.parametrize("tail", ["", "b", " b", "\nb", "7", "　x"])
def test_long_white_space(run, tail):
    enc = bpe.encoding(bpe.RANKS)
    for n in (9_999, 10_000, 10_001, 400_000):
        text = "a" + run * n + tail
        assert bpe.encode_one(enc, text).tolist() == piecewise(enc, text)


def test_very_long_runs(spark):
    texts = [c * 3_000_000 for c in " \ne!"] + ["a" + " " * 1_000_000 + "b <|endoftext|> c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.decoded for r in bpe.encode_texts(docs, decoded=True).collect()}
    assert all(bytes(out[i]) == t.encode() for i, t in enumerate(texts))
    enc = bpe.encoding(bpe.RANKS)
    totals = {r.doc_id: r.n for r in packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert totals.keys() == set(range(5)) and all(n > 1 for n in totals.values()) and enc.n_vocab > 0


def test_head_ties(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 50)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(30)], "doc_id long, text string")
    small = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    monkeypatch.setattr(language_model, "HEAD", 10**6)
    for r in language_model.score_documents(docs).collect():
        assert small[r.doc_id].n_known == r.n_known and abs(small[r.doc_id].base_score - r.base_score) < 1e-9
        assert abs(small[r.doc_id].score - r.score) < 0.2 * abs(r.score)


@pytest.mark.parametrize(
    "page,text",
    [
        ("a<xmp>b<i></xmp>c", "a\n\nb<i>\n\nc"), ("<select><option>x<option selected>y</select>", "y"), ("<select multiple><option>x<option>y</select>", "x y"),
        ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>z", "yes\nz"), ("<details>body<summary>sum</summary>more</details>q", "sum\nq"),
        ("<p aria-hidden=true>icon</p><svg><title>t</title><path/><text>pic</text></svg>", "icon\n\npic"), ("<div>" * 300 + "deep<p hidden>gone</p>" + "</div>" * 300 + "<p>after", "deep\n\nafter"),
        ("<math><mi>x</mi><annotation>tex</annotation></math>", "x"), ("<table><colgroup><col><tr><td>x<td>y</table>", "x  y"),
    ],
)
def test_visibility(page, text):
    assert html.visible_text(page) == text


def test_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 16))
    v[100:140] = v[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "ASKED", 8)
    got: dict = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        scores = v @ v[q]
        want = [i for i in sorted(range(900), key=lambda i: (-scores[i], i)) if i != q][:20]
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(abs(s - scores[i]) < 1e-9 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(want))
    assert hits >= 0.9 * 45 * 20


def test_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(store, "HOT", 4)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(200, 130), (59, 300), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "hi long, lo long")).collect()}
    assert got == {i: 0 for i in [*range(1, 60), 300]} | {i: 100 for i in [*range(101, 131), 200]}
    assert graph.components(spark.createDataFrame([], "hi long, lo long")).count() == 0
    rows, table = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, i int"), spark.createDataFrame([(0, 10, "a"), (1, 10, "b"), (2, 2, "c")], "k int, n int, x string")
    assert sorted((r.i, r.x) for r in store.join_hot(rows, table, "k", "n").collect()) == [(i, "abc"[i % 3]) for i in range(30)]


def test_crowds_are_exact(spark, docs, monkeypatch):
    want = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()}
    for name, value in (("CROWD", 3), ("LIMIT", 4)):
        monkeypatch.setattr(jaccard, name, value)
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()} == want


@pytest.mark.parametrize("families,steps,common,again", [(8, 25, 25, True), (40, 5, 0, False)])
def test_regions_are_cut_again(spark, monkeypatch, families, steps, common, again):
    """Families of sets that drift apart step by step, all in one region: cut more than once where that helps, and exact."""
    rng, rows, levels = random.Random(5), [], []
    for family in range(families):
        words = [f"w{i}" if i < common else f"f{family}w{i}" for i in range(40)]
        for _ in range(steps):
            words[rng.randrange(40)] = f"n{len(rows)}"
            rows.append((len(rows) * 7 % 1009, 5, " ".join(words).encode()))
    members = spark.createDataFrame(rows, "doc long, region long, text binary")
    monkeypatch.setattr(jaccard, "LIMIT", 6)
    inner = jaccard.measured_to_pivots
    monkeypatch.setattr(jaccard, "measured_to_pivots", lambda m, level, *rest: levels.append(level) or inner(m, level, *rest))
    got = {r.node: r.root for r in graph.components(jaccard.large_regions(members, 90, 1)).collect()}
    assert (max(levels) > 0) == again
    sets, root = {d: set(t.split()) for d, _, t in rows}, {d: d for d, _, _ in rows}
    for _ in range(steps):  # least id within reach
        root = {a: min(root[b] for b, y in sets.items() if len(x & y) * 100 >= 90 * len(x | y)) for a, x in sets.items()}
    assert {d: r for d, r in root.items() if d != r} == got


def test_one_id_links_its_sets(spark):
    w = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    near = w(100, "b").replace("b99", "other")
    rows = [(1, w(40, "a")), (2, w(40, "a")), (2, w(100, "b")), (9, near), (None, w(40, "a")), (4, w(5, "c"))]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 1), (2, 1), (4, 4), (9, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_pipeline_on_odd_rows(spark, odd, empty, docs):
    for table in (odd, docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert name == "packing" or out.columns == table.columns
            assert out.count() <= table.count() or name == "packing"
    kept = corpus_pipeline.ngram_jaccard(spark, odd, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and r.text) == [1, 2] and sum(r.doc_id is None for r in kept) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_substrings_and_sql_agree(spark, docs, tmp_path):
    import duckdb

    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet' WHERE doc_id < 500")
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(docs.where("doc_id < 500")).collect()}
    assert got == {tuple(r[:3]) for r in con.sql(sql.SUBSTRINGS).fetchall()}
