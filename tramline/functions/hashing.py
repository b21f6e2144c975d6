"""Consistent hashing and partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def jump(key: int, buckets: int) -> int:
    """Jump consistent hash (Lamping and Veach) of an unsigned 64-bit key."""
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


@F.pandas_udf(LongType())
def jump_hash(key: pd.Series, buckets: pd.Series) -> pd.Series:
    return pd.Series([jump(int(k) & 0xFFFFFFFFFFFFFFFF, int(n)) for k, n in zip(key, buckets, strict=True)], dtype="int64")


def partition(key: Column, n: int) -> Column:
    """Partition of a key by a seeded 64-bit hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
