"""Exact deduplication with counting quotient filters.

Each partition counts the fingerprints of its normalised texts in counting quotient filters, one per
shard of the fingerprint space. Filters of a shard merge without loss, as streams sorted by quotient and
remainder. Only fingerprints whose merged count is above one go on to verification, where rows group by
the bytes of the whole normalised text. A unique text is never shuffled for grouping.

Defined cases. A null text counts as empty. Texts are equal when identical after each run of white space
(space, U+0009 to U+000D) is replaced by one space; the smallest non-null doc_id of a group stays. Rows
that repeat a doc_id and its text are one document and share its decision. A null doc_id never stays while
a non-null one is in its group, and stays if its text is unique. An empty table gives an empty result. Other
columns, whatever their names, are neither read nor returned by :func:`exact_dedup`. :func:`keep` gives whole rows and leaves just one
of each text, whatever the ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.bitmap import bitmap, candidates, flagged
from nearfield.session import materialise, ship
from nearfield.tables import fresh, lookup

#: Bits of a fingerprint that filters hold. False matches only cost a byte comparison.
FINGERPRINT_BITS = 60
#: Fingerprints that one merged shard holds at most, on average: about 100 MB while merging.
SHARD_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """Null as empty, and runs of white space as one space. A run that is one space already is not matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


@dataclass
class CountingQuotientFilter:
    """A static counting quotient filter over fingerprints of ``bits`` bits.

    The upper ``q`` bits of a fingerprint are its quotient, the rest its remainder. Remainders of one
    quotient form a run, sorted; runs follow each other by quotient. ``occupied`` has a bit for each
    quotient, ``runend`` and ``counter`` one for each slot. A slot with its counter bit set holds
    the count of the remainder before it; a remainder without one counts once.
    """

    bits: int
    q: int
    occupied: np.ndarray
    runend: np.ndarray
    counter: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From distinct, ascending fingerprints and their counts."""
        n = len(fingerprints)
        q = max(1, int(n).bit_length())
        r = np.uint64(bits - q)
        quotient = (fingerprints >> r).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        width = np.where(counts > 1, 2, 1)
        end = np.cumsum(width)
        total = int(end[-1]) if n else 0
        slots = np.zeros(total, np.uint64)
        counter = np.zeros(total, bool)
        runend = np.zeros(total, bool)
        slots[end - width] = fingerprints & ((np.uint64(1) << r) - np.uint64(1))
        many = counts > 1
        slots[end[many] - 1] = counts[many].astype(np.uint64)
        counter[end[many] - 1] = True
        if n:
            runend[end[np.append(quotient[1:] != quotient[:-1], True)] - 1] = True
        return cls(bits, q, occupied, runend, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, ascending, and their counts."""
        run = np.cumsum(self.runend) - self.runend
        at = np.flatnonzero(~self.counter)
        quotient = np.flatnonzero(self.occupied)[run[at]].astype(np.uint64)
        counts = np.ones(len(at), np.int64)
        follows = at + 1 < len(self.slots)
        follows[follows] = self.counter[at[follows] + 1]
        counts[follows] = self.slots[at[follows] + 1].astype(np.int64)
        return (quotient << np.uint64(self.bits - self.q)) | self.slots[at], counts

    def to_bytes(self) -> bytes:
        head = struct.pack("<BBQ", self.bits, self.q, len(self.slots))
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter)) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n = struct.unpack_from("<BBQ", data)
        at = struct.calcsize("<BBQ")
        parts = []
        for size in (1 << q, n, n):
            parts.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(bits, q, *parts, np.frombuffer(data, np.uint64, n, at))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: equal fingerprints add their counts; all have the same number of bits."""
        keys, counts = _add(*map(np.concatenate, zip(*(f.items() for f in filters), strict=True)))
        return cls.build(keys, counts, filters[0].bits)


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _filters_of_partition(shards: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FINGERPRINT_BITS)
            keys, counts = _add(np.append(keys, fp), np.append(counts, np.ones(len(fp), np.int64)))
        shard = (keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else []
        ends = [*cuts[1:], len(keys)] if len(keys) else []
        rows = [(int(shard[a]), CountingQuotientFilter.build(keys[a:z], counts[a:z], FINGERPRINT_BITS).to_bytes()) for a, z in zip(cuts, ends, strict=True)]
        for i in range(0, len(rows), 1024):
            part = rows[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.binary())], ["shard", "cqf"])

    return build


def _repeated(table: pa.Table) -> pa.Table:
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("cqf")])
    keys, counts = merged.items()
    many = counts > 1
    return pa.table({"fingerprint": pa.array(keys[many].view(np.int64), pa.int64()), "n": pa.array(counts[many], pa.int64())})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fingerprint, n): those of the one long column whose count over all partitions is above one."""
    spark = fingerprints.sparkSession
    ship(spark)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))
    filters = fingerprints.mapInArrow(_filters_of_partition(shards), "shard long, cqf binary")
    return filters.groupBy("shard").applyInArrow(_repeated, "fingerprint long, n long")


def _fingerprint(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FINGERPRINT_BITS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    slim = materialise(texts.select("doc_id", F.xxhash64("norm").alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-slim")
    repeated = materialise(repeated_fingerprints(slim.select("hash"), slim.count()), "exact-repeated")
    # The bytes decide: rows group by their whole normalised text, after a partial count in each partition.
    same = (
        candidates(texts.withColumn("fingerprint", _fingerprint(F.col("norm"))), "fingerprint", bitmap(repeated, "fingerprint"))
        .join(repeated.select("fingerprint"), "fingerprint", "left_semi")
        .groupBy("norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = materialise(same, "exact-groups")
    # Unique texts pass where they are; the rows of one text, however many, look their group up in many tasks.
    marked = materialise(flagged(slim.select("doc_id", "sha"), "sha", bitmap(groups, "sha"), "may"), "exact-marked")
    alone = marked.where("NOT may").select("sha", "doc_id", F.lit(None).cast(groups.schema["keep_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    out = alone.unionByName(lookup(marked.where("may").drop("may"), "sha", groups, "doc_id", "left").select("sha", "doc_id", "keep_id", "group_size"))
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each normalised text, all columns as they are: that with the smallest id, nulls last, and among equals the smallest digest of the row."""
    norm, mark, may, best = fresh(docs, "_norm", "_mark", "_may", "_best")
    hashes = materialise(docs.select(F.xxhash64(normalised(F.col(text_col))).alias("hash")), "exact-hashes")
    repeated = materialise(repeated_fingerprints(hashes, hashes.count()), "exact-repeated")
    texts = docs.withColumn(norm, normalised(F.col(text_col))).withColumn(mark, _fingerprint(F.col(norm)))
    bits = bitmap(repeated.withColumnRenamed("fingerprint", mark), mark)
    marked = flagged(texts, mark, bits, may)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    # The bytes decide: rows group by their whole normalised text, each partition giving its best row.
    picked = marked.where(F.col(may)).groupBy(norm).agg(F.min_by(F.struct(*docs.columns), order).alias(best)).select(f"{best}.*")
    return marked.where(~F.col(may)).select(docs.columns).unionByName(picked)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
