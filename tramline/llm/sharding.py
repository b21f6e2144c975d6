"""Sharding by a keyed permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: The round function works modulo this prime, in exact 64-bit integers that any SQL engine has.
PRIME = 2147483647
#: Row numbers are given inside so many buckets; one row for each bucket is all that is ever broadcast.
BUCKETS = 4096
#: Steps of a cycle walk. A walk from a row number meets numbers outside the table at most `side` times in a row
#: (all 32 of them for up to 1,024 rows), and with a chance under side^-32 beyond; raise_error guards the rest.
WALK = 40


def permuted(x: str, n: str, side: str, other: str, seed: int) -> str:
    """SQL for the permutation of 0..n-1 at x: three double Feistel rounds on Z_side x Z_other, walked into range."""

    def part(r: str, j: str, odd: int) -> str:
        t = f"((({r}) % {PRIME}) * 48271 + ({j} * 2 + {odd}) * 1103515245 + {seed % PRIME}) % {PRIME}"
        u = f"(({t}) * 69621 + 12345) % {PRIME}"
        return f"((({u}) * ({u})) % {PRIME})"

    left = f"(s.l + {part('s.r', 'j', 0)}) % {side}"
    rounds = f"named_struct('l', {left}, 'r', (s.r + {part(left, 'j', 1)}) % {other})"
    once = lambda v: f"aggregate(sequence(1L, 3L), named_struct('l', ({v}) % {side}, 'r', ({v}) div {side}), (s, j) -> {rounds}, s -> s.r * {side} + s.l)"
    return f"aggregate(sequence(1, {WALK}), {once(x)}, (p, i) -> if(p < {n}, p, {once('p')}))"


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240607) -> DataFrame:
    """Shard and slot of every row: a reproducible shuffle whose shards differ by one row at most.

    Rows get global numbers in the order (bucket, id, checksum, size), the Feistel permutation sends number to place,
    shard = place % shards and slot = place div shards. Numbers come from counts of buckets, so no task sees all rows.

    Returns the id, `size` (UTF-8 bytes + 8), `text_crc32`, `row` (global number), `place`, `shard` and `slot`.
    A null text has size 8 and checksum 0, a null id is an id like others (first in its bucket); rows that agree in
    id, size and checksum are counted first and dealt out again, each with a place of its own; an empty table gives
    no rows; other columns are not read. Whole texts are read once; what is shuffled is three numbers a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    mixed = F.expr(f"((coalesce(pmod(id, {PRIME}), 0) * 48271 + crc % {PRIME}) % {PRIME} * 69621 + size % {PRIME}) % {PRIME} % {BUCKETS}")
    rows = written(thin.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", mixed), "rows")

    total = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket").agg(F.sum("copies").alias("held"))
    starts = starts.select("bucket", F.coalesce(F.sum("held").over(total), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("bucket").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("inner", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    numbered = numbered.join(F.broadcast(starts), "bucket").withColumn("first", F.col("before") + F.col("inner"))
    # copies are dealt out again in two steps with a shuffle of the thin rows between, so that no array is longer than
    # 65,536 and no task deals out more of a group than its share
    numbered = numbered.withColumn("step", F.explode(F.expr("sequence(0L, (copies - 1) div 65536)"))).repartition("bucket", "id", "crc", "step")
    numbered = numbered.withColumn("row", F.explode(F.expr("sequence(first + step * 65536, first + least(copies, (step + 1) * 65536) - 1)")))
    sides = numbered.withColumn("side", F.expr("cast(ceil(sqrt(n)) as bigint)")).withColumn("other", F.expr("(n + side - 1) div side"))
    placed = sides.withColumn("place", F.expr(permuted("row", "n", "side", "other", seed)))
    placed = placed.withColumn("place", F.expr("if(place < n, place, cast(raise_error('cycle walk too long') as bigint))"))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "row", "place", F.expr(f"cast(place % {shards} as int)").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
