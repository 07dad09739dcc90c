"""Exact nearest neighbours, ground truth and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.runs import complete_runs
from nearfield.session import ship

#: Bytes of query vectors that may travel with each task; more are searched in blocks of this size.
BLOCK_BYTES = 32 << 20
METRICS = ("l2", "ip")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be at least 1")


def _values(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """What ascends from the nearest: rough, for selection."""
    return (x * x).sum(1)[None] - 2 * (q @ x.T) + (q * q).sum(1)[:, None] if metric == "l2" else -(q @ x.T)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(((q - x) ** 2).sum(1)) if metric == "l2" else (q * x).sum(1)


def _search(metric: str, k: int, own: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """The k nearest of each query among some vectors; ties to the smaller id."""
    if x.shape[1] != q.shape[1]:
        raise ValueError(f"vectors have {x.shape[1]} components, queries {q.shape[1]}")
    qid, vid, value = [], [], []
    step = max(1, 4_000_000 // len(own))
    for s in range(0, len(q), step):
        rough = _values(q[s : s + step], x, metric)
        for i, row in enumerate(rough):
            c = np.arange(len(own))
            if len(own) > k:
                worst = np.partition(row, k - 1)[k - 1]
                c = np.flatnonzero(row <= worst + 1e-9 * (1 + abs(worst)))
            exact = _exact(q[s + i], x[c], metric)
            c, exact = (z[np.lexsort((own[c], exact if metric == "l2" else -exact))[:k]] for z in (c, exact))
            qid.append(np.full(len(c), ids[s + i]))
            vid.append(own[c])
            value.append(exact)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (qid, vid, value)], ["qid", "vec_id", "value"])


def _over_batches(metric: str, k: int, ids: np.ndarray, q: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _search(metric, k, b.column(0).to_numpy(), matrix(b.column(1)), ids, q)

    return run


def _over_blocks(metric: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_runs(batches, ["shard", "block"]):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                part = t.slice(s, e - s).combine_chunks()
                side, ids = part.column("side").to_numpy(), part.column("id").to_numpy()
                v = matrix(part.column("embedding").combine_chunks())
                if side.any() and not side.all():
                    yield _search(metric, k, ids[side == 0], v[side == 0], ids[side == 1], v[side == 1])

    return run


_HITS = "qid long, vec_id long, value double"


def query_blocks(queries: DataFrame, bytes_each: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of queries(qid, embedding), about :data:`BLOCK_BYTES` at a time, each block in the order of its ids.

    bytes_each: what travels for a query; its components as doubles if not said.
    """
    asks = queries.select(F.col("qid").cast("long"), "embedding")
    n, dim = asks.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = -(-n * max(bytes_each or 0, (dim or 0) * 8) // BLOCK_BYTES)
    for b in range(blocks):
        part = asks if blocks == 1 else asks.where(F.pmod(F.xxhash64("qid"), F.lit(blocks).cast("long")) == b)
        rows = part.orderBy("qid").toPandas()
        if len(rows):
            yield rows["qid"].to_numpy(np.int64), np.stack(rows["embedding"].to_numpy()).astype(np.float64)


def kept(values: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, value) of the k largest of each column of values (rows x queries); ties to the smaller id."""
    at, ids, best = [], [], []
    for j, col in enumerate(values.T):
        c = np.arange(len(own))
        if len(own) > k:
            c = np.flatnonzero(col >= np.partition(col, len(own) - k)[len(own) - k])
        c = c[np.lexsort((own[c], -col[c]))[:k]]
        at.append(np.full(len(c), j))
        ids.append(own[c])
        best.append(col[c])
    return np.concatenate(at), np.concatenate(ids), np.concatenate(best)


def exact_knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(qid, rank, vec_id, value), rank from 1: each query's k nearest of corpus(vec_id, embedding).

    value is the distance, or the inner product for ``ip``. Fewer vectors than k give fewer rows. Queries(qid, embedding) up to
    :data:`BLOCK_BYTES` travel to the vectors, which are read once and never shuffled. More queries are dealt into blocks
    and the corpus into shards of that size, and each pair of the two is a task. Each task or batch gives its own best,
    and a window with an early limit joins those.
    """
    check_k(k)
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    spark = corpus.sparkSession
    ship(spark)
    vectors, asks = corpus.select(F.col("vec_id").cast("long"), "embedding"), queries.select(F.col("qid").cast("long"), "embedding")
    n, dim = asks.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return nothing(spark)
    if n * dim * 8 <= BLOCK_BYTES:
        rows = asks.orderBy("qid").toPandas()
        q = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        found = vectors.mapInArrow(_over_batches(metric, k, rows["qid"].to_numpy(np.int64), q), _HITS)
    else:
        parts = lambda rows: max(1, -(-rows * dim * 8 // BLOCK_BYTES))
        blocks, shards = parts(n), parts(corpus.count())
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m).cast("long"))
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        v = F.transform("embedding", lambda e: e.cast("double")).alias("embedding")
        own = vectors.select(F.col("vec_id").alias("id"), v, deal("vec_id", shards).alias("shard"), F.lit(0).alias("side")).withColumn("block", every(blocks))
        asking = asks.select(F.col("qid").alias("id"), v, deal("qid", blocks).alias("block"), F.lit(1).alias("side")).withColumn("shard", every(shards))
        dealt = own.unionByName(asking).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block")
        found = dealt.mapInArrow(_over_blocks(metric, k), _HITS)
    return ranked(found, k, "value", ascending=metric == "l2")


def ranked(hits: DataFrame, k: int, value: str, ascending: bool, id_col: str = "vec_id") -> DataFrame:
    """The k best hits of each query, with their rank."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy("qid").orderBy(order, id_col)
    out = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("qid", "rank", *[c for c in hits.columns if c != "qid"])


def nothing(spark, value: str = "double") -> DataFrame:
    """The hits of no queries."""
    return spark.createDataFrame([], f"qid long, rank int, vec_id long, value {value}")


def recall(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the k first of truth(qid, rank, vec_id) among the k first of hits, of the fewer if truth is short."""
    want = truth.where(F.col("rank") <= k)
    match = want.join(hits.where(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return match.groupBy("qid").agg((F.count("hit") / F.least(F.lit(k), F.count(F.lit(1)))).alias("recall"))


def overlap(a: DataFrame, b: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by..., overlap): the shared share of two top-k tables for each key that both have."""
    keys = a.select(*by).distinct().join(b.select(*by).distinct(), by)
    both = a.join(b.select(*by, "vec_id"), [*by, "vec_id"]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(both, by, "left").select(*by, (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("overlap"))
