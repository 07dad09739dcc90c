"""Search, index and recall queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.operators import ivf, knn
from nearfield.plans.registry import query, table
from nearfield.session import materialise
from nearfield.sources import index_cache

#: Every row whose id is divisible by this asks.
EVERY, K = 100, 10


def corpus(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def asks(spark, d):
    """Each vector whose id is divisible by :data:`EVERY` asks, against all; each finds itself at distance 0."""
    return corpus(spark, d).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")


def rounded(df, *cols, digits: int = 6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


_Q = f"q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {EVERY} = 0)"
_L2 = """d AS (SELECT qid, vec_id, list_distance(embedding::DOUBLE[], q) AS dist FROM embeddings CROSS JOIN q)"""


def _topk(k: int) -> str:
    return f"SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id))::INTEGER AS rank, vec_id, dist FROM d QUALIFY rank <= {k}"


@query("knn_exact_l2", f"WITH {_Q}, {_L2} SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM ({_topk(K)})")
def knn_exact_l2(spark, d):
    return rounded(knn.exact_knn(corpus(spark, d), asks(spark, d), K).withColumnRenamed("value", "dist"), "dist")


@query(
    "knn_exact_ip",
    f"WITH {_Q}, d AS (SELECT qid, vec_id, list_inner_product(embedding::DOUBLE[], q) AS s FROM embeddings CROSS JOIN q) "
    f"SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id))::INTEGER AS rank, vec_id, round(s, 6) AS score FROM d QUALIFY rank <= {K}",
)
def knn_exact_ip(spark, d):
    return rounded(knn.exact_knn(corpus(spark, d), asks(spark, d), K, "ip").withColumnRenamed("value", "score"), "score")


@query("knn_batch_equals_single", f"WITH {_Q}, {_L2} SELECT qid, list(vec_id ORDER BY rank) AS batch, list(vec_id ORDER BY rank) AS alone FROM ({_topk(K)}) GROUP BY qid")
def knn_batch_equals_single(spark, d):
    """What queries find in one batch, and in batches of a few by a hash of their ids, as lists by rank."""
    x, q = corpus(spark, d), asks(spark, d)
    listed = lambda df, c: df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r["vec_id"]).alias(c))
    parts = [knn.exact_knn(x, q.where(F.pmod(F.xxhash64("qid"), F.lit(3)) == i), K) for i in range(3)]
    alone = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return listed(knn.exact_knn(x, q, K), "batch").join(listed(alone, "alone"), "qid")


@query("ground_truth_topk", f"WITH {_Q}, {_L2} SELECT qid, (rank - 1)::INTEGER AS rank, vec_id FROM ({_topk(100)})")
def ground_truth_topk(spark, d):
    """The 100 nearest, ranks from 0."""
    return knn.exact_knn(corpus(spark, d), asks(spark, d), 100).select("qid", (F.col("rank") - 1).alias("rank"), "vec_id")


@query("knn_k_beyond_corpus", f"WITH {_Q} SELECT qid, least(count(*), 1000000) AS hits FROM embeddings CROSS JOIN q GROUP BY qid")
def knn_k_beyond_corpus(spark, d):
    """k beyond the corpus is capped, never padded."""
    return knn.exact_knn(corpus(spark, d), asks(spark, d), 1_000_000).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))


def _mean_sql(src: str, key: str) -> str:
    """Element-wise means of src(key, embedding) by key as (cid, centroid)."""
    return (
        f"SELECT cid, list(m ORDER BY pos) AS centroid FROM (SELECT {key} AS cid, pos, avg(x) AS m FROM "
        f"(SELECT {key}, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM {src}) GROUP BY {key}, pos) GROUP BY cid"
    )


def _assign_sql(src: str, centroids: str) -> str:
    return (
        f"SELECT vec_id, embedding, cid FROM (SELECT vec_id, embedding, cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], centroid), cid) AS r "
        f"FROM {src} CROSS JOIN {centroids}) WHERE r = 1"
    )


_C0 = f"c0 AS ({_mean_sql('embeddings', 'label')})"
_A0 = f"a0 AS ({_assign_sql('embeddings', 'c0')})"
_C1 = f"c1 AS ({_mean_sql('a0', 'cid')})"
_A1 = f"a1 AS ({_assign_sql('embeddings', 'c1')})"
_C2 = f"c2 AS ({_mean_sql('a1', 'cid')})"
_FLAT = "SELECT cid::BIGINT AS cid, pos, round(x, 6) AS x FROM (SELECT cid, unnest(centroid) AS x, generate_subscripts(centroid, 1)::INTEGER - 1 AS pos FROM {c})"


def _flat(centroids):
    return rounded(centroids.select(F.col("cid").cast("long").alias("cid"), F.posexplode("centroid").alias("pos", "x")), "x")


@query("centroid_mean", f"WITH {_C0} {_FLAT.format(c='c0')}")
def centroid_mean(spark, d):
    return _flat(ivf.label_centroids(corpus(spark, d)))


@query("lloyd_step_1", f"WITH {_C0}, {_A0}, {_C1} {_FLAT.format(c='c1')}")
def lloyd_step_1(spark, d):
    return _flat(ivf.lloyd_step(corpus(spark, d), ivf.label_centroids(corpus(spark, d))))


@query("lloyd_step_2", f"WITH {_C0}, {_A0}, {_C1}, {_A1}, {_C2} {_FLAT.format(c='c2')}")
def lloyd_step_2(spark, d):
    x = corpus(spark, d)
    return _flat(ivf.lloyd_step(x, ivf.lloyd_step(x, ivf.label_centroids(x))))


@query("assign_nearest", f"WITH {_C0}, {_A0} SELECT vec_id, cid::BIGINT AS cid FROM a0")
def assign_nearest(spark, d):
    return ivf.assign(corpus(spark, d), ivf.label_centroids(corpus(spark, d))).select("vec_id", "cid")


@query("cluster_sizes", f"WITH {_C0}, {_A0} SELECT cid::BIGINT AS cid, count(*) AS n FROM a0 GROUP BY cid")
def cluster_sizes(spark, d):
    return ivf.cluster_sizes(ivf.assign(corpus(spark, d), ivf.label_centroids(corpus(spark, d))))


@query(
    "cluster_size_cv",
    f"WITH {_C0}, {_A0}, s AS (SELECT cid, count(*) AS n FROM a0 GROUP BY cid) "
    "SELECT count(*) AS clusters, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n, round(stddev_pop(n), 6) AS std_n, round(stddev_pop(n) / avg(n), 6) AS cv FROM s",
)
def cluster_size_cv(spark, d):
    return rounded(ivf.size_spread(cluster_sizes(spark, d)), "mean_n", "std_n", "cv")


@query("cluster_argmin_tiebreak", f"WITH {_C0}, twice AS (SELECT cid + 100 AS cid, centroid FROM c0 UNION ALL SELECT cid, centroid FROM c0), a AS ({_assign_sql('embeddings', 'twice')}) SELECT vec_id, cid::BIGINT AS cid FROM a")
def cluster_argmin_tiebreak(spark, d):
    """Each centroid stands there twice: the smaller cid wins."""
    x = corpus(spark, d)
    twice = ivf.label_centroids(x).withColumn("cid", F.explode(F.array(F.col("cid") + 100, F.col("cid").cast("long"))))
    return ivf.assign(x, twice.select("cid", "centroid")).select("vec_id", "cid")


_SPREAD = "(SELECT CASE WHEN label < 5 THEN label ELSE label + 3 END AS cid, embedding::DOUBLE[] AS e FROM embeddings)"


@query(
    "empty_cluster_zero_vector",
    f"WITH s AS (SELECT cid, count(*) AS n, sqrt(sum(m * m)) AS norm FROM (SELECT cid, pos, avg(x) AS m FROM (SELECT cid, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM {_SPREAD}) GROUP BY cid, pos) GROUP BY cid), "
    f"z AS (SELECT cid, count(*) AS n FROM {_SPREAD} GROUP BY cid) SELECT r.cid::BIGINT AS cid, coalesce(z.n, 0) AS n, round(coalesce(s.norm, 0), 6) AS norm FROM (SELECT unnest(range(15)) AS cid) r LEFT JOIN z ON z.cid = r.cid LEFT JOIN s ON s.cid = r.cid",
)
def empty_cluster_zero_vector(spark, d):
    """Clusters without members among others: no rows and the zero vector."""
    cid = F.when(F.col("label") < 5, F.col("label")).otherwise(F.col("label") + 3).alias("cid")
    means = ivf.with_empty(ivf.cluster_means(corpus(spark, d).select(cid, "embedding")), 15, 64)
    return rounded(means.select("cid", "n", F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")), "norm")


def _index(spark, d):
    """The corpus, and its index of centroids after one step from the label means, which is written once for an application."""
    x = corpus(spark, d)
    return x, index_cache.build_or_read(x, index_cache.own_root(spark), train=lambda: ivf.lloyd_step(x, ivf.label_centroids(x)), start="labels").index


_ROUTE = f"{_C0}, {_A0}, {_C1}, {_A1}, {_Q}, r AS (SELECT qid, cid, list_distance(q, centroid) AS dist, (row_number() OVER (PARTITION BY qid ORDER BY list_distance(q, centroid), cid))::INTEGER AS pos FROM q CROSS JOIN c1)"


@query("ivf_route", f"WITH {_ROUTE} SELECT qid, pos, cid::BIGINT AS cid, round(dist, 6) AS dist FROM r WHERE pos <= 3")
def ivf_route(spark, d):
    _, index = _index(spark, d)
    return rounded(ivf.route(asks(spark, d), index.centroids, 3), "dist")


def _probe_sql(nprobe: int, k: int = K) -> str:
    return (
        f"SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id))::INTEGER AS rank, vec_id, dist FROM "
        f"(SELECT r.qid, a1.vec_id, list_distance(a1.embedding::DOUBLE[], q.q) AS dist FROM r JOIN a1 USING (cid) JOIN q ON q.qid = r.qid WHERE r.pos <= {nprobe}) QUALIFY rank <= {k}"
    )


@query("ivf_probe_topk", f"WITH {_ROUTE} SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM ({_probe_sql(2)})")
def ivf_probe_topk(spark, d):
    _, index = _index(spark, d)
    return rounded(index.search(asks(spark, d), K, 2).withColumnRenamed("value", "dist"), "dist")


@query("ivf_full_probe_is_exact", f"WITH {_Q}, {_L2} SELECT qid, rank, vec_id, round(dist, 6) AS dist FROM ({_topk(K)})")
def ivf_full_probe_is_exact(spark, d):
    """nprobe beyond the number of clusters probes all."""
    _, index = _index(spark, d)
    return rounded(index.search(asks(spark, d), K, 1000).withColumnRenamed("value", "dist"), "dist")


@query("ivf_batch_per_cluster_best", f"WITH {_ROUTE} SELECT qid, cid::BIGINT AS cid, vec_id FROM (SELECT r.qid, r.cid, a1.vec_id, row_number() OVER (PARTITION BY r.qid, r.cid ORDER BY list_distance(a1.embedding::DOUBLE[], q.q), a1.vec_id) AS n FROM r JOIN a1 USING (cid) JOIN q ON q.qid = r.qid WHERE r.pos <= 2) WHERE n = 1")
def ivf_batch_per_cluster_best(spark, d):
    """The first level of a two-level top-k: the best of each probed cluster."""
    _, index = _index(spark, d)
    q = asks(spark, d)
    return ivf.probe(index.postings, ivf.route(q, index.centroids, 2), q, 1, each_cluster=True).select("qid", "cid", "vec_id")


_SWEEP = (1, 2, 4, 10)


@query(
    "ivf_recall_by_nprobe",
    f"WITH {_ROUTE}, {_L2}, gt AS ({_topk(K)}), "
    + ", ".join(f"h{n} AS (SELECT {n} AS nprobe, qid, vec_id FROM ({_probe_sql(n)}))" for n in _SWEEP)
    + ", h AS (" + " UNION ALL ".join(f"SELECT * FROM h{n}" for n in _SWEEP) + "), "
    f"per AS (SELECT p.nprobe, gt.qid, count(h.vec_id) / {K}.0 AS recall FROM gt CROSS JOIN (SELECT unnest([1, 2, 4, 10]) AS nprobe) p LEFT JOIN h ON h.nprobe = p.nprobe AND h.qid = gt.qid AND h.vec_id = gt.vec_id GROUP BY p.nprobe, gt.qid) "
    "SELECT nprobe, count(*) AS queries, round(avg(recall), 6) AS recall FROM per GROUP BY nprobe",
)
def ivf_recall_by_nprobe(spark, d):
    """One written index serves the whole sweep."""
    x, index = _index(spark, d)
    q = asks(spark, d)
    truth = materialise(knn.exact_knn(x, q, K), "truth")
    out = None
    for n in _SWEEP:
        r = knn.recall(index.search(q, K, n), truth, K).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall")).withColumn("nprobe", F.lit(n))
        out = r if out is None else out.unionByName(r)
    return rounded(out.select("nprobe", "queries", "recall"), "recall")


@query(
    "recall_at_k",
    f"WITH {_Q}, {_L2}, t AS ({_topk(K)}), h AS (SELECT qid, vec_id FROM ({_topk(K)}) WHERE vec_id % 3 <> 0) "
    f"SELECT t.qid, round(count(h.vec_id) / count(*), 6) AS recall FROM t LEFT JOIN h ON h.qid = t.qid AND h.vec_id = t.vec_id GROUP BY t.qid",
)
def recall_at_k(spark, d):
    truth = knn.exact_knn(corpus(spark, d), asks(spark, d), K)
    return rounded(knn.recall(truth.where(F.col("vec_id") % 3 != 0), truth, K), "recall")


@query("latency_chunks", "SELECT chunk, count(*) AS n FROM (SELECT vec_id, vec_id // 64 AS chunk, count(*) OVER () AS total FROM embeddings) WHERE vec_id < (total // 64) * 64 GROUP BY chunk")
def latency_chunks(spark, d):
    """Batches of 64 queries; what is left over is dropped."""
    x = corpus(spark, d).select("vec_id")
    n = x.count()
    return x.where(F.col("vec_id") < n // 64 * 64).groupBy(F.floor(F.col("vec_id") / 64).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("deterministic_sample", "SELECT vec_id FROM embeddings ORDER BY (vec_id * 2654435761) % 4294967296, vec_id LIMIT 50")
def deterministic_sample(spark, d):
    """A sample of an exact size that any engine can repeat: the smallest of a multiplicative hash."""
    x = corpus(spark, d).select("vec_id")
    return x.orderBy((F.col("vec_id") * F.lit(2654435761)) % F.lit(4294967296), "vec_id").limit(50)


@query("vector_checks", "SELECT count(*) AS n, count(DISTINCT len(embedding)) AS dims, count(*) FILTER (WHERE abs(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) < 1e-5) AS unit, bool_and(isfinite(list_sum(embedding::DOUBLE[]))) AS finite FROM embeddings")
def vector_checks(spark, d):
    from nearfield.functions.vectors import all_finite, inner_product

    e = F.col("embedding")
    return corpus(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("embedding")).alias("dims"), F.count_if(F.abs(inner_product(e, e) - 1) < 1e-5).alias("unit"), F.every(all_finite(e)).alias("finite"))


@query("pad_to_width", "SELECT vec_id, 128 AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def pad_to_width(spark, d):
    from nearfield.functions.vectors import pad

    padded = pad(F.col("embedding"), 128)
    return corpus(spark, d).select("vec_id", F.size(padded).alias("width"), F.round(F.aggregate(padded, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))
