"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import join_hot, written

#: Neighbours of a query; hash tables, hashes in each, bucket width (for vectors scaled to norm 1 at most), buckets
#: visited in each table.
NEIGHBOURS, TABLES, HASHES, WIDTH, PROBES = 20, 16, 6, 1.0, 360
#: Distinct vectors of an index block, distinct queries that are looked up in it at once, and those that one copy of a
#: block answers (a block that more of them visit is copied).
BLOCK, CHUNK, ASKED = 8192, 512, 1 << 16
#: Coarse buckets: their width, and how many of them a query visits at most, in the order of estimated success.
WIDE, CELLS = 3.0, 243
SEED = 20240613


@lru_cache(maxsize=8)
def families(dim: int, tables: int, hashes: int, width: float, seed: int = SEED):
    """Projections, offsets and key multipliers of all tables; one extra dimension takes up the norms."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dim + 1, tables * hashes)), rng.uniform(0, width, tables * hashes), rng.integers(1, 2**62, (tables, hashes)) | 1


@lru_cache(maxsize=8)
def probe_sets(hashes: int, probes: int) -> np.ndarray:
    """Perturbations in the order of their estimated success, as rows of marks over the 2M sorted (hash, direction) pairs.

    The expected squared distance to the j-th nearest bucket border of 2M, in units of the width, is j(j+1)/(4(M+1)(M+2))
    in the nearer half and 1 - (2M+1-j)/(M+1) + (2M+1-j)(2M+2-j)/(4(M+1)(M+2)) beyond; a set's score is the sum of its
    members'. Sets are generated from a heap by shifting or extending the last member; a hash moves one way only.
    """
    import heapq

    m = hashes
    score = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out = [np.zeros(2 * m, np.int64)]
    heap = [(score[1], (1,))]
    while heap and len(out) < probes:
        total, members = heapq.heappop(heap)
        if all(2 * m + 1 - j not in members for j in members):
            row = np.zeros(2 * m, np.int64)
            row[[j - 1 for j in members]] = 1
            out.append(row)
        last = members[-1]
        if last < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*members[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*members, last + 1)))
    return np.array(out)


def codes(vectors: np.ndarray, lifted: np.ndarray, tables: int, hashes: int, width: float, seed: int = SEED):
    """Bucket numbers and places within the bucket, (rows, tables, hashes)."""
    a, b, _ = families(vectors.shape[1], tables, hashes, width, seed)
    x = (vectors @ a[:-1] + lifted[:, None] * a[-1] + b) / width
    c = np.floor(x)
    return c.astype(np.int64).reshape(-1, tables, hashes), (x - c).reshape(-1, tables, hashes)


def hashed(index: np.ndarray, greatest: float, tables: int, hashes: int, width: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hash tables of a block: bucket keys in order, and the rows that they are of.

    Vectors are scaled by the greatest norm and lifted onto the unit sphere, queries to norm 1, so that the greatest inner
    products are the least distances.
    """
    index = index / greatest
    code, _ = codes(index, np.sqrt(np.maximum(0, 1 - (index**2).sum(1))), tables, hashes, width)
    times, out = families(index.shape[1], tables, hashes, width)[2], []
    for t in range(tables):
        key = code[:, t] @ times[t]
        order = np.argsort(key, kind="stable")
        out.append((key[order], order))
    return out


def candidates(block: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, hashes: int, width: float, probes: int) -> np.ndarray:
    """Which vectors of a block (columns) share a visited bucket with which queries (rows)."""
    tables, size = len(block), len(block[0][0])
    queries = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    own, inside = codes(queries, np.zeros(len(queries)), tables, hashes, width)
    times = families(queries.shape[1], tables, hashes, width)[2]
    marks = probe_sets(hashes, probes)
    seen = np.zeros((len(queries), size), bool)
    for t, (key, order) in enumerate(block):
        # steps sorted by the distance to the border they cross: down is the place inside, up is the rest of the width
        steps = np.concatenate([inside[:, t], 1 - inside[:, t]], 1)
        rank = np.argsort(steps, axis=1, kind="stable")
        moves = np.concatenate([-times[t], times[t]])[rank]
        keys = (own[:, t] @ times[t])[:, None] + moves @ marks.T
        low, high = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        n = (high - low).ravel()
        if n.sum() > seen.size // 8:  # many: buckets don't overlap, so their borders mark what lies within
            borders = np.zeros((len(queries), size + 1), np.int8)
            at = np.arange(len(queries))[:, None].repeat(keys.shape[1], 1)
            np.add.at(borders, (at, low), 1)
            np.add.at(borders, (at, high), -1)
            place = np.empty(size, np.int64)
            place[order] = np.arange(size)
            seen |= np.cumsum(borders[:, :-1], axis=1, dtype=np.int8).astype(bool)[:, place]
            continue
        take = np.repeat(low.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = np.repeat(np.repeat(np.arange(len(queries)), keys.shape[1]), n)
        seen[rows, order[take]] = True
    return seen


def matrix(column, dim: int) -> np.ndarray:
    """A column of lists, all of length `dim`, as rows."""
    return column.flatten().to_numpy().reshape(-1, dim)


def coarse_cells(vectors: np.ndarray, greatest: float, levels: int, asking: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of coarse buckets and the rows that they are of: an entry's own one, or all that a query visits."""
    rows = np.arange(len(vectors))
    if not levels or not len(vectors):
        return np.zeros(len(vectors), np.int64), rows
    if asking:
        x, lifted = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros(len(vectors))
    else:
        x = vectors / greatest
        lifted = np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))
    code, inside = codes(x, lifted, 1, levels, WIDE, SEED + 1)
    times = families(vectors.shape[1], 1, levels, WIDE, SEED + 1)[2]
    own = code[:, 0] @ times[0]
    if not asking:
        return own, rows
    marks = probe_sets(levels, CELLS)
    rank = np.argsort(np.concatenate([inside[:, 0], 1 - inside[:, 0]], 1), axis=1, kind="stable")
    keys = own[:, None] + np.concatenate([-times[0], times[0]])[rank] @ marks.T
    return keys.ravel(), np.repeat(rows, keys.shape[1])


def look_up(block: list, index: np.ndarray, ids: list, asked: np.ndarray, queries: np.ndarray, greatest: float, k: int, hashes: int, width: float, probes: int) -> pa.RecordBatch:
    """The k + 1 best candidates of each query in a block, by the exact inner product."""
    # a block with fewer vectors than one table has probes is compared whole, which is cheaper
    seen = candidates(block, queries, hashes, width, probes) if len(index) > probes else np.ones((len(queries), len(index)), bool)
    seen[seen.sum(1) <= k] = True  # a query that meets too few visits the whole block
    if seen.mean() < 0.1:
        rows, cols = np.nonzero(seen)
        rough = np.full(seen.shape, -np.inf)
        rough[rows, cols] = np.einsum("ij,ij->i", queries[rows], index[cols])
    else:  # hard data make candidates of half a block: one product of the block is cheaper than picking their rows
        rough = np.where(seen, queries @ index.T, -np.inf)
    margin = 1e-9 * (1 + greatest * np.linalg.norm(queries, axis=1))
    kth = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if rough.shape[1] > k + 1 else np.full(len(rough), -np.inf)
    out = []
    for i, entry in enumerate(asked.tolist()):
        found = np.flatnonzero(seen[i] & (rough[i] >= kth[i] - margin[i]))  # all that may tie with the last stay
        scores = (index[found] * queries[i]).sum(1)
        best = sorted((-s, int(x)) for s, f in zip(scores.tolist(), found.tolist(), strict=True) for x in ids[f])[: k + 1]
        out += [(entry, x, -s) for s, x in best]
    cols = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["entry", "vec", "score"])


def nearest(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """(`query_id`, `rank`, id, `score`): the k nearest found of each row whose id is divisible by `every`, by inner product.

    Equal vectors are one entry of the index with their k + 1 least ids, and equal queries are asked once. Two levels of
    multiprobe hashing: an entry lies in one coarse bucket, by as many hashes as there are doublings from a block to the
    table, and a query goes to the CELLS coarse buckets of greatest estimated success (all of them up to 32 blocks). A
    bucket is a block of BLOCK entries at most, or several by hash if it is full. A task holds a block with its `tables`
    hash tables and streams its queries past it: each visits `probes` buckets of every table, and the merged candidates
    are ranked by the exact inner product in double precision; the best k + 1 go on. So a vector is sent once (and again
    for every ASKED queries of its block), a query once to each block that it visits.

    Vectors that are null, zero, of another length than the commonest, or hold null or non-finite components take no part;
    null ids neither; a repeated (id, vector) row counts once; ties go to the lesser id; with fewer candidates than k all
    found are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    shape = usable.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("norm")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", id_col)
    dim, greatest = shape["dim"], math.sqrt(shape["norm"])
    usable = usable.where(F.size("v") == dim).distinct()  # before the ids of a vector are numbered, or repeats would take places

    least = Window.partitionBy("v").orderBy("id")
    entries = usable.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    entries = written(entries.withColumn("entry", F.element_at("ids", 1)), "entries")
    asking = usable.where(F.col("id") % every == 0).join(entries.select("v", "entry"), "v").select("id", "entry")
    asking = written(asking, "asking")
    asked = entries.join(asking.select("entry").distinct(), "entry", "left_semi").select("entry", "v")

    levels = max(0, math.floor(math.log2(max(1, entries.count()) / BLOCK)))

    def coarse(asking: bool):
        """Entries with their coarse bucket, or queries with all that they visit."""

        def run(batches):
            for batch in batches:
                x = matrix(batch.column(1), dim)
                cells, of = coarse_cells(x, greatest, levels, asking)
                rows = batch.take(pa.array(of))
                yield pa.RecordBatch.from_arrays([pa.array(cells), *rows.columns], ["cell", *batch.schema.names])

        return run

    laid = written(entries.select("entry", "v", "ids").mapInArrow(coarse(False), "cell long, entry long, v array<double>, ids array<long>"), "laid")
    visits = written(asked.select("entry", "v").mapInArrow(coarse(True), "cell long, entry long, v array<double>"), "visits")
    cells = laid.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.join(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asks")), "cell")
    cells = written(cells.select("cell", (F.col("n") + F.col("asks")).alias("size"), F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("parts"), F.expr(f"cast(ceil(asks / {ASKED}) as int)").alias("copies")), "cells")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, seed: F.pmod(F.xxhash64("entry", F.lit(seed)), F.col(n)).cast("int")
    held = join_hot(laid, cells, "cell", "size").withColumn("part", dealt("parts", 1)).withColumn("copy", spread("copies"))
    come = join_hot(visits, cells, "cell", "size").withColumn("copy", dealt("copies", 2)).withColumn("part", spread("parts")).withColumn("ids", F.lit(None).cast("array<bigint>"))
    both = held.unionByName(come).select(F.xxhash64("cell", "part", "copy").alias("block"), F.isnull("ids").alias("asks"), "entry", "v", "ids")

    def search(batches):
        now, index, block, queries, waiting = None, [], None, [], 0

        def answers():
            nonlocal index, block, queries, waiting
            if index and queries:
                if block is None:
                    index = [np.concatenate([v for v, _ in index]), [i for _, lists in index for i in lists]]
                    block = hashed(index[0], greatest, tables, hashes, width)
                at, q = np.concatenate([e for e, _ in queries]), np.concatenate([v for _, v in queries])
                for first in range(0, len(q), CHUNK):
                    part = slice(first, first + CHUNK)
                    yield look_up(block, *index, at[part], q[part], greatest, k, hashes, width, probes)
            queries, waiting = [], 0

        for batch in batches:
            blocks, asks, entry = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            x = matrix(batch.column(3), dim)
            cut = np.flatnonzero(np.append(True, (np.diff(blocks) != 0) | (asks[1:] != asks[:-1]))) if len(blocks) else []
            for a, b in zip(cut, [*cut[1:], len(blocks)], strict=True):
                if blocks[a] != now:
                    yield from answers()
                    now, index, block = blocks[a], [], None
                if not asks[a]:  # a block's entries come before its queries
                    index.append((x[a:b], batch.column(4).slice(a, b - a).to_pylist()))
                    continue
                queries.append((entry[a:b], x[a:b]))
                waiting += b - a
                if waiting >= CHUNK:
                    yield from answers()
        yield from answers()

    # a block is small and takes long, so blocks aren't put together by size
    found = both.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "asks").mapInArrow(search, "entry long, vec long, score double")
    order = [F.desc("score"), F.asc("vec")]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("entry").orderBy(*order))).where(F.col("place") <= k + 1).groupBy("entry").agg(F.collect_list(F.struct("score", "vec")).alias("best"))
    sorted_best = F.expr(f"slice(array_sort(filter(best, x -> x.vec <> id), (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.vec < b.vec then -1 when a.vec > b.vec then 1 else 0 end), 1, {k})")
    out = asking.join(best, "entry").select(F.col("id").alias("query_id"), F.posexplode(sorted_best).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec").alias(id_col), F.col("x.score").alias("score"))


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
