"""Exact Jaccard join of documents as sets of word shingles, by regions around pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import join_hot, written
from .words import WordHashes, hashes, mixed, slices, texts, windows

#: Words of a shingle; two sets link at a Jaccard similarity of PERCENT or more.
WORDS, PERCENT = 3, 90
#: Different sets that one task joins; larger regions are cut around pivots, REGION_PIVOTS at a time.
LIMIT, REGION_PIVOTS = 1000, 16
#: Sets under one key that are compared with each other before regions are formed; more are linked unseen.
CROWD = 2000
#: Documents of a region below which all are compared, and pivots of a region inside a task.
LEAF, PIVOTS = 16, 4


def shingle_sets(batch_texts: list[bytes], table: WordHashes, k: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text; shorter texts have one, texts without words none."""
    split = [t.lower().split() for t in batch_texts]
    flat = hashes([w for ws in split for w in ws], table)
    ends = np.cumsum([len(ws) for ws in split]).tolist() if split else []
    grams = windows(flat, k)
    out, at = [], 0
    for end in ends:
        n = end - at
        if n >= k:
            out.append(np.unique(grams[at : end - k + 1]))
        elif n:
            out.append(windows(flat[at:end], n) + np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def classes(most: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Least sizes of the size classes up to `most`, and how far apart similar sets are whose lesser one is in the class.

    |A xor B| is a metric, and |A| is the distance to the pivot without shingles; so similar sets lie in one class or in
    neighbouring ones. With union <= (|A|+|B|) * 100 / (100 + percent), |A xor B| <= (|A|+|B|) (100-percent)/(100+percent).
    """
    least = [1]
    while least[-1] <= most:
        least.append(least[-1] * 100 // percent + 1)
    least = np.array(least, np.int64)
    top = np.append(least[1:], least[-1] * 100 // percent + 1) - 1
    apart = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    return least, apart


def spare(apart: np.ndarray, percent: int) -> np.ndarray:
    """Parts of a signature beyond those that the bound needs: parts without shingles can be left out, and similar sets
    agree in at least one more than these."""
    return np.maximum(2, apart * (100 - percent) // 60)


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> list[list[tuple[np.ndarray, bytes, int]]]:
    """For each set, as the lesser and as the greater of a pair: its keys, a byte for each part, and how many parts of
    similar sets are equal at least.

    Shingles fall in parts by hash. The distance is the sum of the distances in the parts, so of `apart + 1 + spare`
    parts at least 1 + spare are equal in similar sets. A key names the class, the part and its shingles; similar sets
    that aren't equal share one. A set with up to `spare` empty parts need not show them: one equal part with shingles
    is left.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    out: list[list] = [[] for _ in sets]
    if not len(flat):
        return [[(np.empty(0, np.uint64), b"", 1)] * 2 for _ in sets]
    least, apart = classes(int(sizes.max()), percent)
    extra = spare(apart, percent)
    own = np.searchsorted(least, sizes, "right") - 1
    value = mixed(flat)
    for step in (0, 1):
        group = np.maximum(own - step, 0)
        use = (sizes > 0) & (own >= step) & (apart[group] > 0)
        parts = np.where(use, apart[group] + 1 + extra[group], 0)
        base = np.cumsum(parts) - parts
        rows = np.repeat(use, sizes)
        salt = mixed(group.astype(np.uint64) + np.uint64(77))
        where = (mixed(value ^ np.repeat(salt, sizes)) >> np.uint64(32))[rows]
        slot = np.repeat(base, sizes)[rows] + ((where * np.repeat(parts, sizes)[rows].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total, seen = np.zeros(parts.sum(), np.uint64), np.zeros(parts.sum(), bool)
        np.add.at(total, slot, value[rows])
        seen[slot] = True
        owner = np.repeat(np.arange(len(sets)), parts)
        key = mixed(total ^ mixed(salt[owner] + (np.arange(len(owner)) - base[owner]).astype(np.uint64)))
        show = seen | (np.bincount(owner[~seen], minlength=len(sets))[owner] > extra[group][owner])
        prints = (key >> np.uint64(56)).astype(np.uint8)
        for i, (a, n) in enumerate(zip(base.tolist(), parts.tolist(), strict=True)):
            out[i].append((key[a : a + n][show[a : a + n]], prints[a : a + n].tobytes(), int(extra[group[i]]) + 1))
    return out


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up, self.size, self.parts = list(range(n)), [1] * n, n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            if self.size[x] < self.size[y]:
                x, y = y, x
            self.up[y] = x
            self.size[x] += self.size[y]
            self.parts -= 1


class Index:
    """Sets of a region, with where each shingle occurs."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.value, self.owner = flat[order], owner[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        """Size of the intersection of s with each set."""
        a, b = np.searchsorted(self.value, s, "left"), np.searchsorted(self.value, s, "right")
        n = b - a
        take = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[take], minlength=len(self.sets))

    def near(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance of s to each set, and whether it links."""
        both = self.common(s)
        union = self.sizes + len(s) - both
        return 1 - both / union, both * 100 >= union * percent


def join_region(index: Index, members: list[int], forest: Forest, percent: int) -> None:
    """Links the members of a region: all pairs are compared, or known to be linked already, or too far apart.

    Pivots cut the region into the sets nearest to each (Voronoi regions); a set also goes to another pivot's region if
    it is at most 2r farther from that pivot than from its own, r being the greatest distance of a link: by the triangle
    inequality each link then lies within a region. Regions are joined in the same way.
    """
    if len(members) < 2:
        return
    rows = np.array(members)
    if len(members) > LEAF:
        pivots = members[:: max(1, len(members) // PIVOTS)][:PIVOTS]
        far = np.empty((len(pivots), len(rows)))
        for k, p in enumerate(pivots):
            d, links = index.near(index.sets[p], percent)
            far[k] = d[rows]
            for x in rows[links[rows]].tolist():
                forest.join(p, x)
        if len({forest.root(x) for x in members}) == 1:
            return
        close = far <= far.min(0) + 2 * (100 - percent) / 100 + 1e-9
        if close.sum(1).max() <= 0.8 * len(rows):
            for k in range(len(pivots)):
                join_region(index, rows[close[k]].tolist(), forest, percent)
            return
    # what the largest linked group holds needs no comparing inside; all others meet everything
    done: set[int] = set()
    for x in members:
        roots = [forest.root(y) for y in members]
        largest = max(set(roots), key=roots.count)
        if roots.count(largest) == len(members):
            return
        left = [y for y, r in zip(members, roots, strict=True) if r != largest and y not in done]
        if not left:
            return
        x = left[0]
        done.add(x)
        for y in rows[index.near(index.sets[x], percent)[1][rows]].tolist():
            forest.join(x, y)


def stars(ids: list[int], forest: Forest):
    """Links of every id to the least of its group."""
    least: dict[int, int] = {}
    for i, x in enumerate(ids):
        r = forest.root(i)
        least[r] = min(least.get(r, x), x)
    return [(x, least[forest.root(i)]) for i, x in enumerate(ids) if least[forest.root(i)] != x]


def group_batches(batches, key: str):
    """Consecutive rows of one key, as lists of dicts without the key; the input is sorted by it."""
    now, rows = None, []
    for batch in batches:
        names = [n for n in batch.schema.names if n != key]
        for k, *rest in zip(batch.column(key).to_pylist(), *(batch.column(n).to_pylist() for n in names), strict=True):
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append(rest)
    if rows:
        yield now, rows


def _links(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], ["hi", "lo"])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Id, `n_shingles` and `component_id` (least id reachable by links) of every document.

    1. Documents with equal sets become one, with the least id; copies are never compared.
    2. Size classes and signatures give coarse regions: sets that could link are in one, by the triangle inequality for
       the size of the symmetric difference. Sets that share a key count as neighbours if they agree in as many parts as
       similar sets must. Cutting the whole corpus around pivots by Jaccard distance instead would
       copy every document to every region: unrelated documents are all at distance 1, within any window.
    3. Regions of up to LIMIT sets are joined in a task (`join_region`). Larger ones are cut around pivots over many
       tasks, and so are their parts (`large_regions`).

    Null and empty texts have no shingles and link with nothing. Null ids are left alone (component null), rows with the
    same id count as linked, repeated rows come back repeated, long texts are read whole, an empty table gives no rows.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))

    def describe(batches):
        table = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = shingle_sets(texts(batch.column(1)), table, words)
            whole = [(int(mixed(s).sum()) if len(s) else 0, int(mixed(s ^ np.uint64(0xA5A5A5A5)).sum()) if len(s) else 0) for s in sets]
            one, two = (np.array([x[i] for x in whole], np.uint64).view(np.int64) for i in (0, 1))
            signed = signatures(sets, percent)
            cols = [pa.array([k.tobytes() for k, _, _ in column], pa.binary()) for column in zip(*signed, strict=True)] + [pa.array([x for _, x, _ in column], pa.binary()) for column in zip(*signed, strict=True)] + [pa.array([n for _, _, n in column], pa.int32()) for column in zip(*signed, strict=True)]
            cols = cols or [pa.array([], t) for t in (pa.binary(),) * 4 + (pa.int32(),) * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), *cols], ["doc", "n", "one", "two", "keys0", "keys1", "prints0", "prints1", "need0", "need1"])

    described = written(read.mapInArrow(describe, "doc long, n long, one long, two long, keys0 binary, keys1 binary, prints0 binary, prints1 binary, need0 int, need1 int"), "sets")
    present = described.where("n > 0 and doc is not null")
    sets = present.groupBy("one", "two", "n").agg(F.min(F.struct("doc", "prints0", "prints1", "need0", "need1")).alias("h"))
    sets = written(sets.select("one", "two", "n", "h.*"), "heads")
    # equal sets are one node, by the first half of their name: a task deals the keys of one of its copies, and sets that
    # share a name by chance merely meet in more places

    def unpack(batches):
        seen: set = set()
        for batch in batches:
            if len(seen) > 10**6:
                seen.clear()
            names = batch.column(0).to_numpy()
            fresh = [i for i, x in enumerate(names.tolist()) if x not in seen and not seen.add(x)]
            for step in (0, 1):
                keys = [np.frombuffer(k, np.int64) for k in batch.column(1 + step).take(pa.array(fresh, pa.int64())).to_pylist()]
                n = [len(k) for k in keys]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(names[fresh] & -2 | step, n))], ["key", "node"])

    dealt = present.select("one", "keys0", "keys1").mapInArrow(unpack, "key long, node long").repartition("key").sortWithinPartitions("key", "node")

    def shared(batches):
        """Keys with several nodes, named by their nodes: what similar documents share under many keys is met once."""
        key, node, large = np.empty(0, np.int64), np.empty(0, np.int64), None

        def out(end: int):
            head = np.flatnonzero(np.append(True, key[1:end] != key[: end - 1]))
            size = np.diff(np.append(head, end))
            name = mixed(np.add.reduceat(mixed(node[:end].astype(np.uint64) + np.uint64(1)), head) + size.astype(np.uint64)).view(np.int64)
            one = key[head] == large if large is not None else np.zeros(len(head), bool)
            name[one] = mixed(key[head][one].view(np.uint64)).view(np.int64)
            use = np.repeat((size > 1) | one, size)
            pair = np.unique(np.stack([np.repeat(name, size)[use], node[:end][use]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["key", "node"])

        for batch in batches:
            key, node = np.append(key, batch.column(0).to_numpy()), np.append(node, batch.column(1).to_numpy())
            # the last key waits for the next batch; one that grows beyond any crowd is named by itself, and goes on
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if len(key) - end > 50 * CROWD:
                large, end = key[-1], len(key)
            if end:
                yield from out(end)
                key, node = key[end:], node[end:]
        if len(key):
            yield from out(len(key))

    meeting = written(dealt.mapInArrow(shared, "key long, node long").distinct(), "meeting")
    crowds = written(meeting.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where(F.col("size") > CROWD), "crowds")
    step = lambda i: F.struct(F.col("one").bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(i)).alias("node"), F.col(f"prints{i}").alias("prints"), F.col(f"need{i}").alias("need"))
    nodes = sets.select("doc", F.explode(F.array(step(0), step(1))).alias("x")).select("doc", "x.*").where(F.length("prints") > 0)
    few = meeting.join(crowds.select("key"), "key", "left_anti").join(nodes, "node").select("key", "doc", "need", "prints").repartition("key").sortWithinPartitions("key", "doc")

    def agreeing(batches):
        out: set = set()
        for _, rows in group_batches(batches, "key"):
            forest, need = Forest(len(rows)), rows[0][1]
            ids, parts = [r[0] for r in rows], np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
            left = list(range(len(rows)))
            while len(left) > 1 and forest.parts > 1:
                x = left.pop()
                for y in np.flatnonzero((parts[left] == parts[x]).sum(1) >= need).tolist():
                    forest.join(x, left[y])
            out.update(stars(ids, forest))
            if len(out) > 50000:
                yield _links(out)
                out = set()
        yield _links(out)

    # rows of a crowd are linked unseen, to the least of them
    least = nodes.select(F.col("node").alias("least"), F.col("doc").alias("lo"))
    unseen = meeting.join(crowds, "key").join(nodes.select("node", F.col("doc").alias("hi")), "node").join(least, "least").where("hi <> lo").select("hi", "lo")
    coarse = components(few.mapInArrow(agreeing, "hi long, lo long").unionByName(unseen))
    placed = coarse.select(F.col("node").alias("doc"), F.col("root").alias("region")).unionByName(coarse.select(F.col("root").alias("doc"), F.col("root").alias("region")).distinct())
    sizes = written(placed.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "sizes")
    many = sizes.where(F.col("size") > LIMIT).count()
    placed = join_hot(placed, sizes.withColumn("rows", F.col("size")), "region", "rows")
    in_region = read.where("doc is not null").join(placed, "doc")

    def join_small(batches):
        table, out = WordHashes(), []
        for _, rows in group_batches(batches, "region"):
            rows = {(d, t or b"") for d, t in rows}
            ids, raw = [d for d, _ in rows], [t for _, t in rows]
            own = shingle_sets(raw, table, words)
            use = [i for i, s in enumerate(own) if len(s)]
            ids, own = [ids[i] for i in use], [own[i] for i in use]
            if len(ids) < 2:
                continue
            index, forest = Index(own), Forest(len(own))
            at: dict[int, int] = {}
            for i, d in enumerate(ids):  # rows with one id are one node
                forest.join(at.setdefault(d, i), i)
            join_region(index, list(range(len(own))), forest, percent)
            out += stars(ids, forest)
            if len(out) > 20000:
                yield _links(out)
                out = []
        yield _links(out)

    small = in_region.where(F.col("size") <= LIMIT).select("region", "doc", "text").repartition("region").sortWithinPartitions("region", "doc")
    roots = written(small.mapInArrow(join_small, "hi long, lo long"), "small").groupBy("hi").agg(F.min("lo").alias("lo")).select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    if many:
        roots = roots.unionByName(components(large_regions(in_region.where(F.col("size") > LIMIT), percent, words)))
    # rows of one id with different sets link these sets
    of_row = described.where("n > 0 and doc is not null").select("doc", "one", "two", "n").distinct()
    several = of_row.groupBy("doc").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("doc")
    if several.limit(1).count():
        same = of_row.join(several, "doc", "left_semi").join(sets.select("one", "two", "n", F.col("doc").alias("lo")), ["one", "two", "n"]).select(F.col("doc").alias("hi"), "lo")
        roots = components(roots.select(F.col("node").alias("hi"), F.col("root").alias("lo")).unionByName(same))
    heads = sets.select("one", "two", "n", F.col("doc").alias("head")).join(roots, F.col("head") == F.col("node"), "left")
    heads = heads.select("one", "two", "n", F.coalesce("root", "head").alias("component_id"))
    out = described.select("doc", "n", "one", "two").join(heads, ["one", "two", "n"], "left")
    component = F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def large_regions(members: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (`hi`, `lo`) of the regions with more than LIMIT sets: members has region, doc and text.

    A region is cut around REGION_PIVOTS of its sets. Sets linked to the main group of linked pivots are `known`: they are
    one group, need no comparing among themselves, and go to the part of their nearest pivot; each other set goes to all
    parts within its window. By the triangle inequality a part then holds every link that it has to find, so it is a region
    of its own, cut in the same way around new pivots, as long as a cut halves the comparisons left at least. Regions in
    which all sets are known are done; small ones, and those that a cut doesn't help, are compared in blocks of LIMIT.
    """
    radius, found, leaves, level = (100 - percent) / 100, [], [], 0
    fields = ["region", "doc", "text", "known"]
    members = written(members.select(*fields[:3], F.lit(False).alias("known")), "region")
    many = F.col("rows") * F.col("asks") > LIMIT * LIMIT
    weigh = [F.count(F.lit(1)).alias("rows"), F.sum(F.expr("cast(not known as long)")).alias("asks")]
    while True:
        sized = members.groupBy("region").agg(*weigh).where("asks > 0").withColumn("n", F.col("rows"))
        sized = written(sized, "sizes")
        leaves.append(join_hot(members, sized.where(~many), "region", "n"))
        if not sized.where(many).limit(1).count():
            break
        measured, links = measured_to_pivots(join_hot(members, sized.where(many), "region", "n"), level, percent, words)
        found.append(links)
        mains = measured.groupBy("region", "mask").agg(F.count(F.lit(1)).alias("n")).groupBy("region").applyInPandas(main_group, "region long, main int, n long")
        cells = join_hot(measured, written(mains, "mains"), "region", "n").withColumn("known", F.expr("(mask & main) <> 0"))
        window = F.expr(f"if(known, array(cast(array_position(far, array_min(far)) - 1 as int)), filter(transform(far, (d, i) -> if(d <= array_min(far) + {2 * radius + 1e-9}, cast(i as int), null)), i -> i is not null))")
        cells = cells.withColumn("cells", window)
        parts = cells.select("region", "known", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(*weigh)
        after = parts.groupBy("region").agg(F.sum(F.col("rows") * F.col("asks")).alias("after"))
        verdict = cells.groupBy("region").agg(*weigh).where("asks > 0").join(after, "region").withColumn("n", F.col("rows"))
        verdict = written(verdict.withColumn("leaf", ~many | (F.col("after") * 2 > F.col("rows") * F.col("asks"))), "verdict")
        leaves.append(join_hot(cells, verdict.where("leaf"), "region", "n").select(*fields, "rows", "asks"))
        if not verdict.where("not leaf").limit(1).count():
            break
        cut = join_hot(cells, verdict.where("not leaf").select("region", "n"), "region", "n").select(*fields, F.explode("cells").alias("cell"))
        members, level = written(cut.withColumn("region", F.expr("xxhash64(region, cell)")).select(*fields), "region"), level + 1

    held = leaves[0].select(*fields, "rows", "asks")
    for leaf in leaves[1:]:
        held = held.unionByName(leaf.select(*fields, "rows", "asks"))
    held = held.selectExpr("region", "doc", "text", "known", f"cast(ceil(rows / {LIMIT}) as int) as rows", f"cast(ceil(asks / {LIMIT}) as int) as asks")
    meet = held.withColumn("row", F.expr("cast(pmod(xxhash64(doc), rows) as int)")).withColumn("ask", F.explode(F.expr("sequence(0, asks - 1)"))).withColumn("kind", F.lit(0))
    come = held.where("not known").withColumn("ask", F.expr("cast(pmod(xxhash64(doc), asks) as int)")).withColumn("row", F.explode(F.expr("sequence(0, rows - 1)"))).withColumn("kind", F.lit(1))
    tasks = meet.unionByName(come).select(F.xxhash64("region", "row", "ask").alias("task"), "kind", "doc", "text").repartition("task").sortWithinPartitions("task", "kind", "doc")

    def ask(batches):
        table = WordHashes()
        for _, rows in group_batches(batches, "task"):
            own = shingle_sets([t or b"" for _, _, t in rows], table, words)
            held = [i for i, r in enumerate(rows) if r[0] == 0 and len(own[i])]
            if not held:
                continue
            index, forest, ids = Index([own[i] for i in held]), Forest(len(rows)), [r[1] for r in rows]
            for i, r in enumerate(rows):
                if r[0] == 1 and len(own[i]):
                    for j in np.flatnonzero(index.near(own[i], percent)[1]).tolist():
                        forest.join(i, held[j])
            yield _links(stars(ids, forest))

    out = tasks.mapInArrow(ask, "hi long, lo long")
    for links in found:
        out = out.unionByName(links)
    return out


def measured_to_pivots(members: DataFrame, level: int, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Each set's distances to its region's pivots, and which of them it links to (`mask`; the bit after those of the
    pivots says known); and these links. Pivots are drawn by hash, first among sets that aren't known."""
    order = Window.partitionBy("region").orderBy("known", F.xxhash64("doc", F.lit(level)), "doc", "text")
    chosen = members.select("region", "rows", "known", "doc", "text", F.row_number().over(order).alias("k")).where(F.col("k") <= REGION_PIVOTS)
    pivots = chosen.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("k", "doc", "text"))).alias("pivots"), F.first("rows").alias("rows"))
    pivots = pivots.withColumn("part", F.explode(F.expr(f"sequence(0, cast(ceil(rows / {LIMIT}) as int) - 1)"))).select("region", "part", "pivots")
    dealt = members.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc, 1), ceil(rows / {LIMIT})) as int)")).select("region", "part", "doc", "text", "known")

    def measure(batches):
        table, now, index, ids, out = WordHashes(), None, None, [], []
        kinds = {"region": pa.int64(), "doc": pa.int64(), "text": pa.binary(), "far": pa.list_(pa.float64()), "mask": pa.int32(), "pivots": pa.list_(pa.int64())}
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))
        for batch in batches:
            for region, doc, text, known, pivots in zip(*(batch.column(c).to_pylist() for c in ("region", "doc", "text", "known", "pivots")), strict=True):
                if region != now:
                    now, index, ids = region, Index(shingle_sets([p["text"] or b"" for p in pivots], table, words)), [p["doc"] for p in pivots]
                s = shingle_sets([text or b""], table, words)[0]
                if not len(s):  # a further row of an id, without words
                    continue
                far, links = index.near(s, percent)
                mask = sum(1 << i for i, x in enumerate(links.tolist()) if x) | known << REGION_PIVOTS
                out.append((region, doc, text, far.tolist(), mask, ids))
                if len(out) >= 500:
                    yield flush(out)
                    out = []
        yield flush(out)

    measured = dealt.join(pivots, ["region", "part"]).sortWithinPartitions("region").mapInArrow(measure, "region long, doc long, text binary, far array<double>, mask int, pivots array<long>")
    measured = written(measured, "measured")
    links = measured.select("doc", F.explode(F.expr("transform(filter(sequence(0, size(pivots) - 1), i -> getbit(mask, i) = 1), i -> pivots[i])")).alias("lo"))
    return measured, links.where("doc <> lo").select(F.col("doc").alias("hi"), "lo")


def main_group(key, pdf):
    """The group of pivots, linked by sets that they share, with the most sets; a region has 2^(REGION_PIVOTS + 1) masks at
    most."""
    import pandas as pd

    groups: list[list] = []
    for mask, n in zip(pdf["mask"].tolist(), pdf["n"].tolist(), strict=True):
        if mask:
            joined = [mask, n]
            for g in [g for g in groups if g[0] & mask]:
                joined = [joined[0] | g[0], joined[1] + g[1]]
            groups = [g for g in groups if not g[0] & mask] + [joined]
    best = max(groups, key=lambda g: g[1], default=[0, 0])
    return pd.DataFrame({"region": [key[0]], "main": [best[0]], "n": [int(pdf["n"].sum())]})


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
