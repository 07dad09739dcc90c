"""Approximate nearest neighbours by inner product with a forest of hash-prefix trees.

A tree is a sorted array of long hash strings, one bit for the side of each hyperplane; a tree's hyperplanes are random and orthogonal, which tells
near from far better than independent ones. A query descends each tree to the
longest prefix that it shares with an entry, then all trees ascend together, one bit at a time, and the entries that share the
shortened prefix become candidates until there are enough. Candidates, and no other vectors, are ranked by exact inner products.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors, so that the nearest by angle
is the one with the largest inner product.

Vectors are dealt by a hash into shards of about :data:`SHARD`, queries into blocks of about :data:`QUERIES`. Each pair of the two is
a task with a forest of its shard, and gives each query's ``k`` best; a ranking that limits early joins the shards.
Every vector is indexed. The number of candidates, as a share of a shard, is the smallest that reaches
:data:`TARGET` recall against brute force on a sample of at most :data:`SAMPLE` vectors, of which :data:`SAMPLE_QUERIES` are queries;
at a larger size the same share finds more. Equal vectors of a shard are indexed once with their ``k`` + 1 smallest ids.

Defined cases. Ids are integers. Rows whose id is null, or whose vector is null, empty, zero or holds null or a non-finite component, take no
part. Vectors of different dimension are never compared. Ties go to the smaller id. A query's own id is no candidate; of rows that repeat a query id the one with the
largest vector, compared as an array, asks. Repeated candidate rows are candidates each. Fewer candidates than ``k`` give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.runs import complete_runs, trimmed
from nearfield.sampling import smallest_hashes
from nearfield.session import materialise, ship

TREES, BITS = 256, 24
SHARD, QUERIES = 32_768, 8192
SAMPLE, SAMPLE_QUERIES, TARGET = 8192, 128, 0.93
#: Shares of a shard that are tried, counted over all trees, with what several trees name.
SHARES = (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.8, 1.0, 1.3, 1.6, 2.0, 3.0, 4.0, 8.0, float(TREES))
#: Queries that ascend at once.
TOGETHER = 512


class Forest:
    """Sorted hash strings of ``x``, unit vectors by row in single precision, for each tree."""

    def __init__(self, x: np.ndarray) -> None:
        self.planes = _hyperplanes(x.shape[1])
        self.order, self.keys = [], []
        for codes in self.codes(x):
            order = np.argsort(codes, kind="stable").astype(np.int32)
            self.order.append(order)
            self.keys.append(codes[order])

    def codes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        place = np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32)
        for p in self.planes:
            yield ((x @ p) > 0).astype(np.uint32) @ place

    def ascend(self, q: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) by tree and query: the entries of each tree that are candidates.

        All trees stand at one level; those that come first in order stand one level above once that is enough.
        """
        codes = list(self.codes(q))
        n = len(self.keys[0])
        low, high = np.zeros((TREES, len(q)), np.int64), np.full((TREES, len(q)), n)
        open_ = np.arange(len(q))
        below = None
        for level in range(BITS, -1, -1):
            lo, hi = np.empty((TREES, len(open_)), np.int64), np.empty((TREES, len(open_)), np.int64)
            span = (1 << (BITS - level)) - 1
            for t in range(TREES):
                first = codes[t][open_].astype(np.int64) & ~span
                lo[t] = np.searchsorted(self.keys[t], first)
                hi[t] = np.searchsorted(self.keys[t], first + span, side="right")
            full = (hi - lo).sum(0) >= min(enough, TREES * n)
            if full.any():
                at = np.flatnonzero(full)
                a, z = lo[:, at], hi[:, at]
                if below is not None:  # as many trees as needed ascend, the rest stay
                    lo0, hi0 = below[0][:, at], below[1][:, at]
                    gain = np.cumsum((z - a) - (hi0 - lo0), 0) + (hi0 - lo0).sum(0)
                    stay = np.vstack([np.zeros(len(at), bool), gain[:-1] >= enough])
                    a, z = np.where(stay, lo0, a), np.where(stay, hi0, z)
                low[:, open_[at]], high[:, open_[at]] = a, z
            open_, below = open_[~full], (lo[:, ~full], hi[:, ~full])
            if not len(open_):
                break
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Positions of one query's candidates."""
        seen = np.zeros(len(self.keys[0]), bool)
        for order, a, z in zip(self.order, low.tolist(), high.tolist(), strict=True):
            seen[order[a:z]] = True
        return np.flatnonzero(seen)


def _hyperplanes(dim: int) -> np.ndarray:
    """(trees, dim, bits): orthogonal within a tree, as far as there are dimensions."""
    g = np.random.default_rng(dim).standard_normal((TREES, dim, BITS))
    parts = [np.linalg.qr(g[:, :, s : s + dim])[0] for s in range(0, BITS, dim)]
    return np.ascontiguousarray(np.concatenate(parts, 2), np.float32)


def _unit(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]]).astype(np.float32)


def _directions(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(1, keepdims=True)
    return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]).astype(np.float32)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, share: float, largest: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of each query's ``k`` best among its candidates.

    Candidates are measured in single precision first; those that rounding could bring among the best are measured exactly.
    """
    order = np.argsort(ids, kind="stable")
    _, at, group = np.unique(x[order], axis=0, return_index=True, return_inverse=True)
    members = np.argsort(group.ravel(), kind="stable")  # by distinct vector, ascending ids
    ends = np.cumsum(np.bincount(group.ravel()))
    distinct = np.ascontiguousarray(x[order][at])
    unit = _unit(distinct, largest)
    forest = Forest(unit)
    enough = max(TREES, int(share * len(distinct)))
    slack = 4e-7 * unit.shape[1]
    for start in range(0, len(q), TOGETHER):
        own = q[start : start + TOGETHER]
        directions = _directions(own)
        low, high = forest.ascend(directions, enough)
        for i, query in enumerate(own):
            c = forest.candidates(low[:, i], high[:, i])
            if len(c) > k + 1:
                rough = unit[c] @ directions[i]
                c = c[rough >= np.partition(rough, len(c) - k - 1)[len(c) - k - 1] - slack]
            score = (distinct[c] * query).sum(1)
            own_ids = [order[members[ends[g - 1] if g else 0 : ends[g]][: k + 1]] for g in c.tolist()]
            found = ids[np.concatenate(own_ids)] if own_ids else np.zeros(0, np.int64)
            score = np.repeat(score, [len(m) for m in own_ids])
            other = found != query_ids[start + i]
            found, score = found[other], score[other]
            best = np.lexsort((found, -score))[:k]
            yield int(query_ids[start + i]), found[best], score[best]


def share_curve(x: np.ndarray, k: int, largest: float) -> Iterator[tuple[float, float, float]]:
    """(share over all trees, share of the vectors that are candidates, recall) on distinct vectors, for each of :data:`SHARES`."""
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(7).permutation(len(x))]
    n = min(SAMPLE_QUERIES, len(x))
    exact = x[:n] @ x.T
    exact[np.arange(n), np.arange(n)] = -np.inf
    best = np.argpartition(-exact, k, axis=1)[:, :k]
    forest, directions = Forest(_unit(x, largest)), _directions(x[:n])
    for share in SHARES:
        low, high = forest.ascend(directions, max(TREES, int(share * len(x))))
        hits = named = 0
        for i in range(n):
            c = forest.candidates(low[:, i], high[:, i])
            named += len(c)
            hits += np.isin(best[i], c, assume_unique=True).sum()
        yield share, named / n / len(x), hits / n / k


def choose_share(x: np.ndarray, k: int, largest: float) -> float:
    """The smallest of :data:`SHARES` that reaches the target on a sample of vectors."""
    if len(np.unique(x, axis=0)) > k + 1:
        for share, _, recall in share_curve(x, k, largest):
            if recall >= TARGET:
                return share
    return SHARES[-1]


def _valid(v: Column) -> Column:
    # The sum of squares in double precision is finite and positive just for these vectors.
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda e: e != 0)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search_runs(k: int, share: float, largest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_runs(batches, ["dim", "shard", "block"]):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                part = t.slice(s, e - s)
                ids, side = part.column("vec_id").to_numpy(), part.column("side").to_numpy()
                x = _matrix(part.column("v"), part.column("dim")[0].as_py())
                if side.all() or not side.any():
                    continue
                rows = list(search(ids[side == 0], x[side == 0], ids[side == 1], x[side == 1], k, share, largest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]), pa.int64()), pa.array(np.concatenate([r[1] for r in rows]), pa.int64()), pa.array(np.concatenate([r[2] for r in rows]), pa.float64())],
                    ["query_id", "vec_id", "score"],
                )

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query``, its ``k`` nearest found among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    own = materialise(own.withColumn("dim", F.size("v").cast("long")), "near-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    n, asking, largest = own.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, partitions = -(-n // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A bounded sample, of one dimension and no larger than a shard, to choose how many candidates are enough.
    sample = smallest_hashes(own.select("vec_id", "v"), ["vec_id"], min(SAMPLE, -(-n // shards)), n).toPandas()["v"].map(np.asarray)
    dim = sample.map(len).mode()[0]
    share = choose_share(np.stack(sample[sample.map(len) == dim]), k, largest)
    # Blocks are as large as QUERIES allows, for a vector travels once to each; only small inputs are cut further, to use all cores.
    blocks = max(1, -(-asking // QUERIES), min(-(-partitions // shards), asking // 64))
    deal = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    corpus = own.select("vec_id", "v", "dim").withColumn("shard", deal(1, shards)).withColumn("block", every(blocks)).withColumn("side", F.lit(0))
    asks = own.where("asks").groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v").cast("long"))
    asks = asks.withColumn("block", deal(2, blocks)).withColumn("shard", every(shards)).withColumn("side", F.lit(1))
    rows = corpus.unionByName(asks).repartition(max(shards * blocks, partitions), "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block")
    found = materialise(rows.mapInArrow(trimmed(_search_runs(k, share, largest)), "query_id long, vec_id long, score double"), "near-found", 4000)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
