"""Bitmaps of keys of a fixed size, to keep wide rows out of shuffles that they cannot match in.

A key sets one of :data:`BITS` bits. The bitmap is a table of at most BITS / 64 rows of two integers, 16 MB, so it may be broadcast whatever
the number of keys; with many more keys than bits it lets all rows through and only the join that follows decides. A row without
its bit has no match for certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialise
from nearfield.tables import fresh

BITS = 1 << 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(_word, _bits) of a column of keys."""
    place = keys.select(_place(F.col(key)).alias("p"))
    bit = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    return materialise(place.groupBy(F.floor(F.col("p") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "bitmap")


def flagged(df: DataFrame, key: str, bits: DataFrame, flag: str) -> DataFrame:
    """df with a boolean column that is false where the key has no match for certain. df may have columns of any names."""
    at, held = fresh(df, "_word", "_bits")
    own = bits.select(F.col("_word").alias(at), F.col("_bits").alias(held))
    joined = df.join(F.broadcast(own), F.floor(_place(F.col(key)) / 64) == F.col(at), "left")  # at most BITS / 64 rows
    hit = F.coalesce(F.getbit(F.col(held), (_place(F.col(key)) % 64).cast("int")) == 1, F.lit(False))
    return joined.withColumn(flag, hit).drop(at, held)


def candidates(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows of df whose key may have a match."""
    (may,) = fresh(df, "_may")
    return flagged(df, key, bits, may).where(F.col(may)).drop(may)


def anti_join(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in gone. Only rows that may match are shuffled; the others pass where they are."""
    gone = materialise(gone.select(key).where(F.col(key).isNotNull()), "gone")
    (may,) = fresh(df, "_may")
    marked = flagged(df, key, bitmap(gone, key), may)
    certain = marked.where(~F.col(may)).drop(may)
    return certain.unionByName(marked.where(F.col(may)).drop(may).join(gone, key, "left_anti").select(df.columns))
