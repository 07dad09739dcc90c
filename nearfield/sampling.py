"""Exact-size samples by a hash of the row's keys: the same rows at every partitioning, and few of them in one task."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniform(*keys: str, salt: int = 0):
    """A draw in [0, 1) from the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(salt)), 11) / F.lit(float(1 << 53))


def smallest_hashes(df: DataFrame, keys: list[str], n: int, total: int | None = None, salt: int = 0) -> DataFrame:
    """The ``n`` rows with the smallest hashes of their keys; all rows if there are no more.

    A threshold on the hash, some deviations above the share that is needed, leaves little more than ``n`` rows to be sorted
    in one task, whatever the number of partitions. Were it ever short, the rows at hand would be fewer, never others.
    """
    total = df.count() if total is None else total
    draw = uniform(*keys, salt=salt)
    if total > n:
        df = df.where(draw < F.lit((n + 8 * sqrt(n) + 50) / total))
    return df.orderBy(draw, *keys).limit(n)
