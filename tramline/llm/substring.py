"""Removal of long passages that an earlier document holds too."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import join_hot, written
from .words import WordHashes, hashes, mixed, slices, texts, windows

#: Words of a passage, and of the grams among which a passage's anchor is chosen.
PASSAGE, GRAM = 50, 10
#: An anchor with more different surroundings than this is too common to be dealt as one. Its passages get the least of
#: their longer grams as anchor; where that is too common as well, passages are matched one by one by their own hash.
COMMON, LONG_GRAM = 400, 40
#: Common anchors that are told apart at most (8 bytes each are broadcast); others are merely dealt less evenly.
MOST_COMMON = 50_000


class SuffixAutomaton:
    """Generalised suffix automaton over words: all word sequences inside the passages put in so far."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            if (q := nxt[last].get(c)) is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal spans of words covered by matches of `least` words or more, from the matching statistics."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= least:
                start = i + 1 - matched
                if out and start <= out[-1][1]:
                    out[-1] = (min(out[-1][0], start), i + 1)
                else:
                    out.append((start, i + 1))
        return out


def passage_anchors(h: np.ndarray, gram: int) -> np.ndarray:
    """The least hash among the grams of each passage: equal passages have equal anchors wherever they stand."""
    reach = PASSAGE - gram + 1
    grams = mixed(windows(h, gram) + np.uint64(gram))
    least, size = grams, 1
    while size * 2 <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(grams) - reach + 1
    return np.minimum(least[:n], least[reach - size :][:n])


def cut(anchor: np.ndarray, use: np.ndarray, doc: np.ndarray, passage: np.ndarray, reach: int):
    """Runs of consecutive passages (those in `use`) with one anchor: first and last passage, anchor, hash of the words.

    A run has `reach` passages at most (longer ones, of periodic text, are cut); its first and last passage then cover
    it, and their hashes stand for it.
    """
    at = np.flatnonzero(use)
    if not len(at):
        return at, at, anchor[at], passage[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]) | (np.diff(at) > 1)
    head = np.flatnonzero(fresh)
    since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    fresh |= since % reach == 0
    head = np.flatnonzero(fresh)
    first, last = at[head], at[np.append(head[1:], len(at)) - 1]
    return first, last, anchor[first], mixed(passage[first] * np.uint64(0x9E3779B97F4A7C15) + passage[last] + (last - first).astype(np.uint64))


def runs(h: np.ndarray, doc: np.ndarray):
    """The runs of a batch, as by `cut`, and the hash of each passage."""
    passage = windows(h, PASSAGE)
    if not len(passage):
        empty = np.empty(0, np.int64)
        return empty, empty, passage, passage, passage
    whole = doc[: len(passage)] == doc[PASSAGE - 1 :]
    return *cut(passage_anchors(h, GRAM), whole, doc, passage, PASSAGE - GRAM + 1), passage


def laid_out(batch_texts: list[bytes], table: WordHashes):
    split = [t.split() for t in batch_texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    return flat, hashes(flat, table), np.repeat(np.arange(len(split)), sizes), np.cumsum(sizes) - sizes


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Id, `row_hash`, `rest` (a struct of the columns `keep`), `n_words`, `n_removed` and `kept` (the words left, joined by one space) of every document.

    A word goes if a passage of PASSAGE words around it also starts in a document with a smaller id, judged on the input.

    1. Each passage has an anchor, the least of its grams' hashes. Anchors of one document only are set aside: what they
       stand in can't repeat. The others' runs of passages are dealt by anchor, so equal passages meet.
    2. Equal runs are counted as one, with the smallest id. For each anchor a suffix automaton takes up the runs in order
       of id; before it does, each run is streamed through it, and its matching statistics give the spans of PASSAGE
       words or more that earlier documents hold.
    3. Spans go back to the documents, whole runs to those with a greater id than the run's first.

    The automata thus are built where the documents that need them are dealt, not broadcast to all, which would take time
    in proportion to the square of the corpus. An anchor amid ever different surroundings (the edge of a passage in a
    third of all documents) is not dealt as one; see COMMON and `one_by_one`. So an automaton holds COMMON runs of 90
    words at most.

    Null and empty texts have no words. Documents with a null id lose nothing and take nothing from others. Rows with one
    id don't repeat each other. An empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))

    def anchors(batches):
        table = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids = batch.column(0).to_numpy()
            _, h, doc, _ = laid_out(texts(batch.column(1)), table)
            first, _, anchor, content, _ = runs(h, doc)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[doc[first]], pa.int64())], ["anchor", "content", "doc"])

    found = written(read.where("doc is not null").mapInArrow(anchors, "anchor long, content long, doc long"), "anchors")
    contents = found.groupBy("anchor", "content").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = written(contents.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("contents")).where("low < high").select("anchor", "contents"), "shared")
    common = sorted(r["anchor"] for r in shared.where(F.col("contents") > COMMON).orderBy(F.desc("contents")).select("anchor").limit(MOST_COMMON).collect())
    common = spark.sparkContext.broadcast(np.array(common, np.int64))

    wanted = found.select("anchor", "doc").join(shared.select("anchor"), "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))

    def passages(batches):
        table, usual = WordHashes(), common.value
        for batch in (part for whole in batches for part in slices(whole, 2)):
            ids, raw = batch.column(0).to_numpy(), texts(batch.column(2))
            hashed = batch.column(1).to_numpy()
            flat, h, doc, begin = laid_out(raw, table)
            first, last, anchor, content, passage = runs(h, doc)
            anchor = anchor.view(np.int64)
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            base = offsets[0]
            values = values[base : offsets[-1]] if len(offsets) else values
            # (document, anchor) pairs that are wanted, as one sorted array of hashes
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(offsets))
            pairs = np.sort(mixed(mixed(owner + np.uint64(1)) ^ values.view(np.uint64)))
            mine = mixed(mixed(doc[first].astype(np.uint64) + np.uint64(1)) ^ anchor.view(np.uint64))
            at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
            ok = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            first, last, anchor, content = first[ok], last[ok], anchor[ok], content[ok]
            if len(usual) and len(anchor):
                hot = usual[np.minimum(np.searchsorted(usual, anchor), len(usual) - 1)] == anchor
                use = np.zeros(len(passage) + 1, np.int32)
                np.add.at(use, first[hot], 1)
                np.add.at(use, last[hot] + 1, -1)
                again = cut(passage_anchors(h, LONG_GRAM), np.cumsum(use[:-1]) > 0, doc, passage, PASSAGE - LONG_GRAM + 1)
                first, last, anchor, content = (np.append(x[~hot], y) for x, y in zip((first, last, anchor, content), (again[0], again[1], again[2].view(np.int64), again[3]), strict=True))
            words = [b" ".join(flat[a : b + PASSAGE]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            d = doc[first]
            for k in range(0, len(words), 4000):
                part = slice(k, k + 4000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[part]), pa.array(content[part].view(np.int64)), pa.array(ids[d[part]], pa.int64()), pa.array(hashed[d[part]], pa.int64()), pa.array((first - begin[d])[part].astype(np.int32)), pa.array((last - first + PASSAGE)[part].astype(np.int32)), pa.array(words[part], pa.binary())],
                    ["anchor", "content", "doc", "row_hash", "start", "length", "words"],
                )

    hashed = read.select("doc", F.xxhash64("text").alias("row_hash"), "text")
    occurrences = written(hashed.join(wanted, "doc").mapInArrow(passages, "anchor long, content long, doc long, row_hash long, start int, length int, words binary"), "passages")

    distinct = occurrences.groupBy("anchor", "content").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("words").alias("words"))

    def matched(batches):
        anchor, group = None, []

        def finish():
            """Runs of one anchor in order of id, those of one document together: matched first, taken up then."""
            if len(group) > 1:
                automaton, waiting, now = SuffixAutomaton(), [], None
                for content, low, high, words in group:
                    if low != now:
                        for w in waiting:
                            automaton.add(w)
                        waiting, now = [], low
                    w = words.split()
                    waiting.append(w)
                    yield anchor, content, low, high, automaton.spans(w, PASSAGE)
            else:
                for content, low, high, _ in group:
                    yield anchor, content, low, high, []

        def out(rows):
            rows = [r for r in rows if r[4] or r[3] > r[2]]
            if rows:
                a, c, low, _, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(low, pa.int64()), pa.array([[{"s": x, "e": y} for x, y in s] for s in spans], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["anchor", "content", "low", "spans"])

        ready: list = []
        for batch in batches:
            for a, content, low, high, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    ready += finish()
                    anchor, group = a, []
                    if len(ready) > 5000:
                        yield from out(ready)
                        ready = []
                group.append((content, low, high, words))
        ready += finish()
        yield from out(ready)

    # anchors that are too common even so: their runs' passages are matched one by one
    crowded = written(occurrences.select("anchor", "content").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") > COMMON).select("anchor"), "crowded")
    some = crowded.count() > 0
    dealt = distinct.join(crowded, "anchor", "left_anti") if some else distinct
    dealt = dealt.select("anchor", "content", "low", "high", "words").repartition("anchor").sortWithinPartitions("anchor", "low", "content")
    known = dealt.mapInArrow(matched, "anchor long, content long, low long, spans array<struct<s:int,e:int>>")
    if some:
        known = known.unionByName(one_by_one(distinct.join(crowded, "anchor", "left_semi")))
    back = occurrences.select("anchor", "content", "doc", "row_hash", "start", "length").join(known, ["anchor", "content"])
    whole = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e")))
    shifted = F.expr("transform(spans, x -> struct(x.s + start as s, x.e + start as e))")
    spans = back.select("doc", "row_hash", F.when(F.col("doc") > F.col("low"), whole).otherwise(shifted).alias("spans")).where(F.size("spans") > 0)
    spans = spans.groupBy("doc", "row_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def strip(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            kept, total, gone = [], [], []
            for text, spans in zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                stay = np.ones(len(words), bool)
                for x in spans or ():
                    stay[x["s"] : x["e"]] = False
                left = words if not spans else [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc", "row_hash", "rest", "n_words", "n_removed", "kept"])

    rest = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    every = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"), rest.alias("rest"))
    every = every.select("doc", F.xxhash64("text").alias("row_hash"), "text", "rest").join(spans, ["doc", "row_hash"], "left").select("doc", "row_hash", "text", "spans", "rest")
    schema = StructType([f for f in every.schema.fields if f.name in ("doc", "row_hash", "rest")]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    out = every.mapInArrow(strip, schema)
    return out.withColumnRenamed("doc", id_col)


def one_by_one(distinct: DataFrame) -> DataFrame:
    """Spans of crowded runs (as `known` in remove_repeats): each passage is an automaton of its own 50 words, by hash."""

    def split(batches):
        table = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 4)):
            _, h, doc, begin = laid_out(texts(batch.column(4)), table)
            passage = windows(h, PASSAGE)
            at = np.flatnonzero(doc[: len(passage)] == doc[PASSAGE - 1 :]) if len(passage) else np.empty(0, np.int64)
            own = doc[at]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(passage[at].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array((at - begin[own]).astype(np.int32))], ["passage", "anchor", "content", "low", "at"])

    crowd = written(distinct.select("anchor", "content", "low", "high", "words"), "crowd")
    passages = written(crowd.mapInArrow(split, "passage long, anchor long, content long, low long, at int"), "places")
    first = passages.groupBy("passage").agg(F.min("low").alias("first"), F.max("low").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("passage", "first", "n")
    spans = join_hot(passages, written(first, "firsts"), "passage", "n").where("low > first").groupBy("anchor", "content").agg(F.expr(f"transform(sort_array(collect_list(at)), x -> struct(x as s, x + {PASSAGE} as e))").alias("spans"))
    out = crowd.select("anchor", "content", "low", "high").join(spans, ["anchor", "content"], "left").where("high > low or spans is not null")
    return out.select("anchor", "content", "low", F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias("spans"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
