"""Inverted-file index: k-means, postings, routing and probing."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators.kernels import nearest, rng, squared
from nearfield.operators.knn import _search, check_k, exact_knn, matrix, nothing, query_blocks, ranked
from nearfield.sampling import smallest_hashes
from nearfield.session import discard, materialise, ship

#: Bytes of centroids that the driver holds and tasks take along; more are searched in blocks.
CENTROID_BYTES = 64 << 20
#: Vectors from which initial centroids are drawn at most.
INIT_SAMPLE = 20_000


def default_centroids(n: int) -> int:
    return ceil(sqrt(n))


def few(centroids: DataFrame) -> bool:
    """Whether centroids may travel whole."""
    n, dim = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    return n * (dim or 0) * 8 <= CENTROID_BYTES


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cluster ids, ascending, and their centroids; refused beyond :data:`CENTROID_BYTES`."""
    if not few(centroids):
        raise ValueError(f"the centroids are more than {CENTROID_BYTES} bytes")
    rows = centroids.select("cid", "centroid").orderBy("cid").toPandas()
    return rows["cid"].to_numpy(np.int64), np.stack(rows["centroid"].to_numpy()).astype(np.float64)


def _as_vectors(centroids: DataFrame) -> DataFrame:
    return centroids.select(F.col("cid").alias("vec_id"), F.col("centroid").alias("embedding"))


def assign(corpus: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, embedding, cid): the nearest centroid, the smallest cid among equals.

    Without a shuffle where the centroids may travel; otherwise vectors and centroids are dealt into blocks as in any exact search.
    """
    ship(corpus.sparkSession)
    if not few(centroids):
        near = exact_knn(_as_vectors(centroids), corpus.select(F.col("vec_id").alias("qid"), "embedding"), 1).select(F.col("qid").alias("vec_id"), F.col("vec_id").alias("cid"))
        return corpus.select(F.col("vec_id").cast("long"), "embedding").join(near, "vec_id")
    cids, c = centroid_matrix(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = cids[nearest(matrix(b.column(1)), c)] if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best)], ["vec_id", "embedding", "cid"])

    kind = corpus.select("embedding").schema[0].dataType.simpleString()
    return corpus.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, cid long")


def cluster_means(assigned: DataFrame) -> DataFrame:
    """(cid, centroid array<double>, n). Batches add up their vectors; only sums are shuffled."""
    ship(assigned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cid, x = b.column(0).to_numpy(), matrix(b.column(1))
                own, at = np.unique(cid, return_inverse=True)
                sums = np.zeros((len(own), x.shape[1]))
                np.add.at(sums, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at)), pa.array(list(sums))], ["cid", "n", "sums"])

    parts = assigned.select(F.col("cid").cast("long"), "embedding").mapInArrow(run, "cid long, n long, sums array<double>")
    n = F.sum("n").alias("n")
    cells = parts.select("cid", "n", F.posexplode("sums").alias("pos", "part")).groupBy("cid", "pos").agg(F.sum("part").alias("total"), n)
    # A cluster has as many cells as vectors have components.
    ordered = F.array_sort(F.collect_list(F.struct("pos", (F.col("total") / F.col("n")).alias("m"))))
    return cells.groupBy("cid").agg(F.transform(ordered, lambda z: z["m"]).alias("centroid"), F.max("n").alias("n"))


def with_empty(means: DataFrame, k: int, dim: int) -> DataFrame:
    """Clusters 0 to k - 1; one without members has the zero vector."""
    every = means.sparkSession.range(k).withColumnRenamed("id", "cid")
    return every.join(means, "cid", "left").select("cid", F.coalesce("centroid", F.array_repeat(F.lit(0.0), dim)).alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def label_centroids(corpus: DataFrame, label: str = "label") -> DataFrame:
    """A deterministic start: the mean of each label's vectors."""
    return cluster_means(corpus.select(F.col(label).alias("cid"), "embedding")).select("cid", "centroid")


def lloyd_step(corpus: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cid, centroid): the means of the vectors nearest each centroid."""
    return cluster_means(assign(corpus, centroids)).select("cid", "centroid")


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Initial centroids: the first uniform, each next in proportion to the squared distance from those before."""
    g = rng(seed, "k-means++")
    chosen = [int(g.integers(len(x)))]
    far = squared(x, x[chosen])[:, 0]
    while len(chosen) < k:
        total = far.sum()
        at = int(min(np.searchsorted(np.cumsum(far), g.random() * total, side="left"), len(x) - 1)) if total > 0 else int(g.integers(len(x)))
        chosen.append(at)
        far = np.minimum(far, squared(x, x[[at]])[:, 0])
    return x[chosen].copy()


def train(corpus: DataFrame, k: int | None = None, seed: int = 42, max_iter: int = 25) -> DataFrame:
    """(cid, centroid) after Lloyd's steps until nothing moves or ``max_iter``.

    The start is drawn from at most :data:`INIT_SAMPLE` vectors, or k if that is more; every step reads all vectors. Each step's centroids are a table.
    """
    spark = corpus.sparkSession
    n = corpus.count()
    k = default_centroids(n) if k is None else k
    if not n or k <= 0 or k > n:
        raise ValueError(f"{k} centroids need as many vectors; there are {n}")
    sample = smallest_hashes(corpus.select("vec_id", "embedding"), ["vec_id"], max(INIT_SAMPLE, k), n, salt=seed).orderBy("vec_id").toPandas()
    start = plus_plus(np.stack(sample["embedding"].to_numpy()).astype(np.float64), k, seed)
    dim, c = start.shape[1], _frame(spark, start)
    for _ in range(max_iter):
        new = materialise(with_empty(lloyd_step_means(corpus, c), k, dim).select("cid", "centroid"), "centroids")
        moved = new.join(c.withColumnRenamed("centroid", "before"), "cid").where(F.col("centroid") != F.col("before")).limit(1).count()
        c = new
        if not moved:
            break
    return c


def lloyd_step_means(corpus: DataFrame, centroids: DataFrame) -> DataFrame:
    return cluster_means(assign(corpus, centroids))


def _frame(spark: SparkSession, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "cid long, centroid array<double>")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


def size_spread(sizes: DataFrame) -> DataFrame:
    """One row: clusters, min, max, mean, population deviation and its ratio to the mean."""
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("std_n"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))


def route(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, pos, cid, dist): each query's nearest clusters, pos from 1; nprobe beyond their number gives all."""
    return exact_knn(_as_vectors(centroids), queries, nprobe).select("qid", F.col("rank").alias("pos"), F.col("vec_id").alias("cid"), F.col("value").alias("dist"))


class Plain:
    """Distances to vectors as they are; see :class:`nearfield.operators.schemes.Scheme` for what it offers."""

    name, value, ascending, query_bytes = "plaintext", "double", True, 0

    def encoded(self, postings: DataFrame) -> DataFrame:
        return postings

    def asking(self, q: np.ndarray) -> "PlainQueries":
        return PlainQueries(q)


@dataclass
class PlainQueries:
    q: np.ndarray

    def best(self, part: pa.RecordBatch, at: np.ndarray, k: int, spent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, distance) of the k nearest rows of part to each of the queries at."""
        began = time.perf_counter()
        found = _search("l2", k, part.column("vec_id").to_numpy(), matrix(part.column("embedding")), at, self.q[at])
        spent("server-compute", time.perf_counter() - began)
        return tuple(c.to_numpy() for c in found.columns)


def _over_postings(qids: np.ndarray, wanted: dict[int, np.ndarray], asked, k: int, kind: pa.DataType, spent, rows: int = 500):
    """The k best rows of each batch and cluster for the queries that want the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = b.column("cid").to_numpy()
            order = np.argsort(cid, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(cid[order]) != 0)) if len(cid) else []
            for s, e in zip(starts, [*starts[1:], len(cid)], strict=True):
                at = wanted.get(int(cid[order[s]]))
                if at is None:
                    continue
                for i in range(s, e, rows):
                    place, ids, values = asked.best(b.take(pa.array(order[i : min(e, i + rows)])), at, k, spent)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[place]), pa.array(np.full(len(ids), cid[order[s]])), pa.array(ids), pa.array(values, kind)], ["qid", "cid", "vec_id", "value"])

    return run


def _ignore(step: str, seconds: float) -> None:
    pass


#: Clusters that a filter names one by one, so that only their files are read.
NAMED = 2000


def answers(postings: DataFrame, qids: np.ndarray, wanted: dict[int, np.ndarray], asked, k: int, value: str, spent=_ignore) -> DataFrame:
    """(qid, cid, vec_id, value): what each batch of wanted clusters holds of each query's k best. Nothing is shuffled.

    ``wanted`` has the places of the queries by cluster, ``asked`` their encoded forms; both travel with the tasks.
    """
    ship(postings.sparkSession)
    if len(wanted) <= NAMED:
        postings = postings.where(F.col("cid").isin([int(c) for c in wanted]))
    kind = pa.int64() if value == "long" else pa.float64()
    return postings.mapInArrow(_over_postings(qids, wanted, asked, k, kind, spent), f"qid long, cid long, vec_id long, value {value}")


def wanted_of(places: np.ndarray, cids: np.ndarray) -> dict[int, np.ndarray]:
    """Places of the queries by cluster, from one entry for each query and cluster."""
    order = np.argsort(cids, kind="stable")
    own, starts = np.unique(cids[order], return_index=True)
    return {int(c): np.sort(p) for c, p in zip(own, np.split(places[order], starts[1:]), strict=True)}


def probe(postings: DataFrame, routes: DataFrame, queries: DataFrame, k: int, scheme=None, each_cluster: bool = False) -> DataFrame:
    """(qid, rank, vec_id, value): the k best of the clusters that each query is routed to by routes(qid, cid).

    Queries and routes travel to the postings in blocks, and only batches' best rows are shuffled. ``postings`` is what ``scheme`` has encoded.
    each_cluster: the k best of each cluster instead, as (qid, cid, rank, vec_id, value).
    """
    scheme = scheme or Plain()
    check_k(k)
    routes = materialise(routes.select("qid", "cid"), "routes")
    per, out = routes.groupBy("qid").count().agg(F.max("count")).first()[0] or 0, None
    dim = queries.select(F.max(F.size("embedding"))).first()[0] or 0
    for qids, q in query_blocks(queries, max(scheme.query_bytes, dim * 8) + 16 * per):
        own = routes.where(F.col("qid").isin(qids.tolist())) if len(qids) <= NAMED else routes
        rows = own.toArrow()
        place = np.searchsorted(qids, rows.column("qid").to_numpy())
        here = (place < len(qids)) & (qids[np.minimum(place, len(qids) - 1)] == rows.column("qid").to_numpy())
        found = answers(postings, qids, wanted_of(place[here], rows.column("cid").to_numpy()[here]), scheme.asking(q), k, scheme.value)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return nothing(postings.sparkSession, scheme.value)
    return best_of(out, k, scheme.ascending, each_cluster)


def best_of(found: DataFrame, k: int, ascending: bool, each_cluster: bool = False) -> DataFrame:
    if not each_cluster:
        return ranked(found.drop("cid"), k, "value", ascending)
    order = F.col("value").asc() if ascending else F.col("value").desc()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "cid").orderBy(order, "vec_id"))).where(F.col("rank") <= k)


@dataclass
class Index:
    """Centroids and postings (cid, vec_id, embedding), or postings as a scheme has encoded them."""

    centroids: DataFrame
    postings: DataFrame

    @cached_property
    def few(self) -> bool:
        return few(self.centroids)

    @cached_property
    def known(self) -> tuple[np.ndarray, np.ndarray]:
        return centroid_matrix(self.centroids)

    def routes(self, q: np.ndarray, nprobe: int) -> dict[int, np.ndarray]:
        """Places of the queries by cluster, found where the centroids are known already."""
        cids, c = self.known
        found = _search("l2", min(nprobe, len(cids)), cids, c, np.arange(len(q)), q)
        return wanted_of(found.column(0).to_numpy(), found.column(1).to_numpy())

    def search(self, queries: DataFrame, k: int, nprobe: int, scheme=None) -> DataFrame:
        """(qid, rank, vec_id, value) by one probe of all queries' clusters; a block of queries at a time where there are many."""
        scheme, out = scheme or Plain(), None
        check_k(k)
        check_k(nprobe)
        if not self.few:
            return probe(self.postings, route(queries, self.centroids, nprobe), queries, k, scheme)
        for qids, q in query_blocks(queries, scheme.query_bytes):
            found = answers(self.postings, qids, self.routes(q, nprobe), scheme.asking(q), k, scheme.value)
            out = found if out is None else out.unionByName(found)
        return nothing(self.postings.sparkSession, scheme.value) if out is None else best_of(out, k, scheme.ascending)

    def encoded(self, scheme) -> "Index":
        """The same clusters with postings that ``scheme`` has encoded, written once."""
        return Index(self.centroids, materialise(scheme.encoded(self.postings), "encoded"))


def build(corpus: DataFrame, centroids: DataFrame | None = None, **training) -> Index:
    """Centroids and postings are written once, postings in the order of clusters, so that a probe reads the parts of its clusters."""
    centroids = materialise(train(corpus, **training) if centroids is None else centroids, "centroids")
    return Index(centroids, materialise(_in_order(assign(corpus, centroids)), "postings"))


def _in_order(postings: DataFrame) -> DataFrame:
    """By ranges of cluster and vector, which part a large cluster too."""
    return postings.repartitionByRange("cid", "vec_id").sortWithinPartitions("cid", "vec_id")


def write(index: Index, path: str) -> None:
    """Postings are a folder for each cluster, so that a probe reads only its clusters."""
    index.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    _in_order(index.postings).write.mode("overwrite").partitionBy("cid").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str) -> Index:
    postings = spark.read.parquet(f"{path}/postings")
    return Index(spark.read.parquet(f"{path}/centroids"), postings.withColumn("cid", F.col("cid").cast("long")))


__all__ = ["Index", "Plain", "answers", "assign", "build", "cluster_means", "cluster_sizes", "discard", "label_centroids", "lloyd_step", "materialise", "probe", "read", "route", "size_spread", "train", "write"]
