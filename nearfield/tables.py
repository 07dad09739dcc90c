"""Helpers for tables with columns of any names, and for keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt over.
SALTS = 64


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that are no columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def lookup(df: DataFrame, key: str, table: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """df with the columns of ``table``, which has one row for a key and the same name for it.

    However many rows of df share a key, they meet in no one task: a hash of the column ``spread`` deals them over :data:`SALTS`, and the table's row
    goes to those of them that are in use. df is read twice. Null keys find nothing.
    """
    (salt,) = fresh(df, "_salt")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)))
    homes = salted.where(F.col(key).isNotNull()).select(key, salt).distinct().join(table, key)
    return salted.join(homes, [key, salt], how).drop(salt)
