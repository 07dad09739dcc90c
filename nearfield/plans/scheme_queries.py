"""Queries of the scoring variants and of their costs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearfield.functions import vectors as v
from nearfield.operators import costs, ivf, knn, schemes
from nearfield.plans.registry import query, table
from nearfield.plans.vector_queries import _C0, _Q, _ROUTE, K, _index, asks, corpus, rounded
from nearfield.sources import index_cache

Q, P = v.Q20, v.P61
SCALE = 1.5


def _quantised(x: str) -> str:
    return f"list_transform({x}::DOUBLE[], lambda e: round(e * {Q}))"


#: Integers under 2^41 and their sums are exact in doubles.
_QIP = f"d AS (SELECT qid, vec_id, list_inner_product({_quantised('embedding')}, {_quantised('q')})::BIGINT AS product FROM embeddings CROSS JOIN q)"
_QIP_TOP = f"SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY product DESC, vec_id))::INTEGER AS rank, vec_id, product FROM d QUALIFY rank <= {K}"


@query(
    "sap_beta0_topk",
    f"WITH {_Q}, d AS (SELECT qid, vec_id, list_distance(list_transform(embedding::DOUBLE[], lambda x: {SCALE} * x), list_transform(q, lambda x: {SCALE} * x)) AS dist FROM embeddings CROSS JOIN q) "
    f"SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id))::INTEGER AS rank, vec_id, round(-dist, 6) + 0.0 AS score FROM d QUALIFY rank <= {K}",
)
def sap_beta0_topk(spark, d):
    """Without noise, scaled distances rank like plain ones; each tie goes to the smaller id."""
    key = schemes.ScaleKey(SCALE, "fixed")
    c = schemes.scale_encrypt(corpus(spark, d), key).withColumnRenamed("cipher", "embedding")
    q = schemes.scale_encrypt(asks(spark, d), key, id_col="qid").withColumnRenamed("cipher", "embedding")
    hits = knn.exact_knn(c, q, K)
    return hits.select("qid", "rank", "vec_id", (F.round(-F.col("value"), 6) + 0.0).alias("score"))


@query(
    "sap_route_plain_score_cipher",
    f"WITH {_ROUTE} SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id))::INTEGER AS rank, vec_id, round(dist, 5) AS dist FROM "
    f"(SELECT r.qid, a1.vec_id, list_distance(list_transform(a1.embedding::DOUBLE[], lambda x: {SCALE} * x), list_transform(q.q, lambda x: {SCALE} * x)) AS dist FROM r JOIN a1 USING (cid) JOIN q ON q.qid = r.qid WHERE r.pos <= 2) QUALIFY rank <= {K}",
)
def sap_route_plain_score_cipher(spark, d):
    """Clusters come from the plain query, distances from ciphertexts."""
    _, index = _index(spark, d)
    key = schemes.ScaleKey(SCALE, "fixed")
    cipher = schemes.scale_encrypt(index.postings, key).withColumnRenamed("cipher", "embedding")
    postings = index.postings.select("cid", "vec_id").join(cipher, "vec_id")
    q = asks(spark, d)
    hidden = schemes.scale_encrypt(q, key, id_col="qid").withColumnRenamed("cipher", "embedding")
    hits = ivf.probe(postings, ivf.route(q, index.centroids, 2), hidden, K)
    return rounded(hits.withColumnRenamed("value", "dist"), "dist", digits=5)


_BETA = 0.5


@query(
    "sap_noise_in_ball",
    f"SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * {schemes.scale_keygen().scale}, 6) AS scaled, true AS within, true AS moved FROM embeddings",
)
def sap_noise_in_ball(spark, d):
    """Noise stays within scale * beta / 4 of the scaled vector, and is there; the norm that it is measured against is that of SQL."""
    key, x = schemes.scale_keygen(), corpus(spark, d)
    scaled = F.transform("embedding", lambda e: e.cast("double") * F.lit(key.scale))
    far, zero = v.l2(F.col("cipher"), scaled), F.transform("cipher", lambda e: F.lit(0.0))
    both = schemes.scale_encrypt(x, key, _BETA).join(x, "vec_id")
    return both.select("vec_id", F.round(v.l2(scaled, zero), 6).alias("scaled"), (far <= key.scale * _BETA / 4 + 1e-9).alias("within"), (far > 0).alias("moved"))


_SMALL = schemes.Trapdoor(ell0=64, n=81, b=9)


@query("emvp_ip_topk", f"WITH {_Q}, {_QIP} SELECT qid, rank, vec_id, product, round(product / {float(Q) ** 2}, 6) AS score FROM ({_QIP_TOP})")
def emvp_ip_topk(spark, d):
    """Encode, block products and decode give the exact fixed-point inner product."""
    hits = schemes.top(_SMALL, corpus(spark, d), asks(spark, d), K).withColumnRenamed("value", "product")
    return hits.withColumn("score", F.round(F.col("product") / float(Q) ** 2, 6))


_ROUTED = f"WITH {_ROUTE}, d AS (SELECT r.qid, a1.vec_id, list_inner_product({_quantised('a1.embedding')}, {_quantised('q.q')})::BIGINT AS product FROM r JOIN a1 USING (cid) JOIN q ON q.qid = r.qid WHERE r.pos <= 2) {_QIP_TOP}"


def _encoded(spark, d, scheme):
    """The index of the embeddings as a scheme has encoded it, written once for an application."""
    return index_cache.build_or_read_encoded(scheme, _index(spark, d)[1], index_cache.own_root(spark))[0]


@query("emvp_ivf_topk", _ROUTED)
def emvp_ivf_topk(spark, d):
    """Encoded queries against the encoded rows of routed clusters, and decoded answers: products of the whole corpus are never formed."""
    return _encoded(spark, d, _SMALL).search(asks(spark, d), K, 2, _SMALL).withColumnRenamed("value", "product")


_LONG = f"""a AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
f AS (SELECT vec_id, pos, ((round(x * {Q})::HUGEINT % {P}) + {P}) % {P} AS e FROM a)"""


@query(
    "emvp_block_partials",
    f"WITH {_LONG}, g AS (SELECT vec_id AS qid, pos, e FROM f WHERE vec_id % 100 = 0) "
    f"SELECT vec_id, qid, block, part FROM (SELECT f.vec_id, g.qid, (f.pos // {_SMALL.b})::BIGINT AS block, (sum((f.e * g.e) % {P}) % {P})::BIGINT AS part FROM f JOIN g ON f.pos = g.pos GROUP BY ALL)",
)
def emvp_block_partials(spark, d):
    """Partial products of column blocks over the field by the server's kernel, for rows and queries that are not masked."""
    x, q = corpus(spark, d), asks(spark, d)
    plain = lambda e: F.transform(e, lambda c: v.to_field(c))
    return schemes.block_partials(_SMALL, x.select("vec_id", plain(F.col("embedding")).alias("row")), q.select("qid", plain(F.col("embedding")).alias("row")))


@query("emvp_field_roundtrip", f"WITH {_LONG} SELECT vec_id, pos::INTEGER AS pos, e::BIGINT AS e, CASE WHEN e > {P // 2} THEN (e - {P})::BIGINT ELSE e::BIGINT END AS back FROM f")
def emvp_field_roundtrip(spark, d):
    cells = corpus(spark, d).select("vec_id", F.posexplode(F.transform("embedding", lambda x: v.to_field(x))).alias("pos", "e"))
    return cells.withColumn("back", v.signed_lift(F.col("e")))


@query("field_arithmetic", f"SELECT vec_id, ((e + 7) % {P})::BIGINT AS plus, ((e - 7 + {P}) % {P})::BIGINT AS minus, (({P} - e) % {P})::BIGINT AS neg, ((e * e) % {P})::BIGINT AS square FROM (SELECT vec_id, ((round(embedding[1]::DOUBLE * {Q})::HUGEINT % {P}) + {P}) % {P} AS e FROM embeddings)")
def field_arithmetic(spark, d):
    e, seven = F.col("e"), F.lit(7).cast("long")
    x = corpus(spark, d).select("vec_id", v.to_field(F.col("embedding")[0]).alias("e"))
    return x.select("vec_id", v.field_add(e, seven).alias("plus"), v.field_sub(e, seven).alias("minus"), v.field_neg(e).alias("neg"), v.field_multiply(e, e).alias("square"))


_BLIND = schemes.Blinded(n=64, shrink=3)


@query("bn_ip_topk", f"WITH {_Q}, {_QIP} {_QIP_TOP}")
def bn_ip_topk(spark, d):
    """Blinded matrix and query, unblinded answer: the signed fixed-point product itself."""
    return schemes.top(_BLIND, corpus(spark, d), asks(spark, d), K).withColumnRenamed("value", "product")


@query("bn_ivf_topk", _ROUTED)
def bn_ivf_topk(spark, d):
    """Blinded queries against the blinded rows of routed clusters, and unblinded answers."""
    return _encoded(spark, d, _BLIND).search(asks(spark, d), K, 2, _BLIND).withColumnRenamed("value", "product")


@query("bn_matvec_modp", f"WITH {_LONG}, g AS (SELECT vec_id AS qid, pos, e FROM f WHERE vec_id % 100 = 0) SELECT f.vec_id, g.qid, (sum((f.e * g.e) % {P}) % {P})::BIGINT AS y FROM f JOIN g ON f.pos = g.pos GROUP BY f.vec_id, g.qid")
def bn_matvec_modp(spark, d):
    """The server's matrix product over the field: all rows with each query, none of them blinded."""
    plain = lambda e: F.transform(e, lambda c: v.to_field(c))
    whole = schemes.Trapdoor(ell0=64, n=65, b=65)  # one block of columns
    rows = schemes.block_partials(whole, corpus(spark, d).select("vec_id", plain(F.col("embedding")).alias("row")), asks(spark, d).select("qid", plain(F.col("embedding")).alias("row")))
    return rows.select("vec_id", "qid", F.col("part").alias("y"))


_CHECKED = f"WITH {{with_}} SELECT {{of}}, t.trial, true AS honest, bool_or(vec_id = 0) AS meddled FROM {{rows}} CROSS JOIN (SELECT unnest(range({_BLIND.trials})) AS trial) t GROUP BY ALL"


@query("bn_freivalds", _CHECKED.format(with_=_Q, of="qid", rows="q CROSS JOIN embeddings"))
def bn_freivalds(spark, d):
    """Every trial passes for an honest answer and fails for the one cluster whose answer is off by one for vector 0."""
    x, q = corpus(spark, d), asks(spark, d)
    both = _BLIND.verify(x, q).withColumnRenamed("ok", "honest").join(_BLIND.verify(x, q, tamper=1).withColumnRenamed("ok", "tampered"), ["qid", "cid", "trial"])
    return both.select("qid", "trial", "honest", (~F.col("tampered")).alias("meddled"))


@query("bn_ivf_freivalds", _CHECKED.format(with_=_ROUTE, of="qid, cid::BIGINT AS cid", rows="(SELECT r.qid, r.cid, a1.vec_id FROM r JOIN a1 USING (cid) WHERE r.pos <= 2)"))
def bn_ivf_freivalds(spark, d):
    """The same for each cluster that a query is routed to: only the cluster of vector 0 fails."""
    _, index = _index(spark, d)
    q = asks(spark, d)
    routes = ivf.route(q, index.centroids, 2)
    check = lambda tamper, c: _BLIND.verify(index.postings, q, tamper, routes).withColumnRenamed("ok", c)
    return check(0, "honest").join(check(1, "tampered"), ["qid", "cid", "trial"]).select("qid", "cid", "trial", "honest", (~F.col("tampered")).alias("meddled"))


@query(
    "bn_sparse_dense",
    f"WITH {_LONG}, s AS (SELECT unnest([3, 17, 40, 63]) AS pos, unnest([1, -1, -1, 1]) AS sign) SELECT vec_id, ((sum(sign * e) % {P} + {P}) % {P})::BIGINT AS y FROM f JOIN s ON f.pos = s.pos GROUP BY vec_id",
)
def bn_sparse_dense(spark, d):
    """A dense matrix times a sparse vector of signs, by the kernel that blinding uses."""
    signs = schemes.sparse_field(np.array([3, 17, 40, 63]), np.array([1, -1, -1, 1]), 64)
    whole = schemes.Trapdoor(ell0=64, n=65, b=65)
    query_row = spark.createDataFrame([(0, [int(x) for x in signs])], "qid long, row array<long>")
    rows = schemes.block_partials(whole, corpus(spark, d).select("vec_id", F.transform("embedding", lambda c: v.to_field(c)).alias("row")), query_row)
    return rows.select("vec_id", F.col("part").alias("y"))


_RET = schemes.Retrieval(bits=4, p=1 << 15, n=256)
_CODE = "list_transform({x}, lambda e: greatest(-15, least(15, round((e::FLOAT * 15::FLOAT)::DOUBLE))))"


@query("tiptoe_quantise", f"SELECT vec_id, pos::INTEGER AS pos, (((c::BIGINT) % {_RET.p}) + {_RET.p}) % {_RET.p} AS code FROM (SELECT vec_id, unnest({_CODE.format(x='embedding')}) AS c, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def tiptoe_quantise(spark, d):
    codes = F.transform("embedding", lambda x: v.clamp_quantise(x, _RET.bits, _RET.p))
    return corpus(spark, d).select("vec_id", F.posexplode(codes).alias("pos", "code"))


_ONE = f"WITH {_ROUTE}, d AS (SELECT r.qid, a1.vec_id, list_inner_product({_CODE.format(x='a1.embedding')}, {_CODE.format(x='q.q::FLOAT[]')})::BIGINT AS product FROM r JOIN a1 USING (cid) JOIN q ON q.qid = r.qid WHERE r.pos = 1) SELECT qid, rank, vec_id, round(product / 225.0, 6) AS score FROM ({_QIP_TOP})"


@query("tiptoe_single_cluster_topk", _ONE)
def tiptoe_single_cluster_topk(spark, d):
    """Encrypted queries, linear answers, hints by limbs and recovered products within the one nearest cluster, from a written encoded index."""
    hits = _encoded(spark, d, _RET).search(asks(spark, d), K, 1, _RET)
    return hits.select("qid", "rank", "vec_id", F.round(F.col("value") / 225.0, 6).alias("score"))


@query("pir_single_cluster_topk", _ONE)
def pir_single_cluster_topk(spark, d):
    """The same ranking from postings that are encoded as the probe reads them, along a table of routes."""
    _, index = _index(spark, d)
    q = asks(spark, d)
    hits = ivf.probe(_RET.encoded(index.postings), ivf.route(q, index.centroids, 1), q, K, _RET)
    return hits.select("qid", "rank", "vec_id", F.round(F.col("value") / 225.0, 6).alias("score"))


@query("pir_limb_decompose", "SELECT o_orderkey, limb, value, o_orderkey AS back FROM (SELECT o_orderkey, unnest([0, 1, 2, 3, 4]) AS limb, unnest([o_orderkey & 15, (o_orderkey >> 4) & 15, (o_orderkey >> 8) & 15, (o_orderkey >> 12) & 15, (o_orderkey >> 16) & 15]) AS value FROM orders)")
def pir_limb_decompose(spark, d):
    """The five lowest limbs of each key, and the key put together from all of its limbs, once a row."""
    whole = table(spark, d, "orders").select("o_orderkey", schemes.limbs(F.col("o_orderkey")).alias("parts"))
    whole = whole.withColumn("back", schemes.from_limbs(F.col("parts")))
    return whole.select("o_orderkey", F.posexplode(F.slice("parts", 1, 5)).alias("limb", "value"), "back")


# Costs: labels stand for clusters.

DIM, NPROBE = 64, 2
_SIZES = "s AS (SELECT label AS cid, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT sum(n)::BIGINT AS m, count(*)::BIGINT AS c, max(n)::BIGINT AS largest FROM s)"
_HIT = f"8 * least({K}, m // c)"
_COST_SQL = {
    "plaintext": (f"{4 * DIM}", f"{_HIT} * {NPROBE}", _HIT, "0", "0", "0", f"{NPROBE} * (m // c) * {4 * DIM}"),
    "sap": (f"{8 * DIM}", f"{8 * K}", f"{8 * K}", "0", "0", "0", f"m * {4 * DIM}"),
    "sap-ivf": (f"{8 * DIM}", f"{_HIT} * {NPROBE}", _HIT, "0", "0", "0", f"{NPROBE} * (m // c) * {4 * DIM}"),
    "emvp": ("10336", "m * 608", "m * 608", "m * 10336", "0", "0", "m * 10336"),
    "emvp-ivf": ("10336", f"round(m / c * 608) * {NPROBE}", "round(m / c * 608)", "m * 10336", "0", "0", f"{NPROBE} * round(m / c) * 10336"),
    "bntm": ("8192", "m * 8", "m * 8", "m * 8192", "0", "0", "m * 8192"),
    "bntm-ivf": ("8192", f"round(m / c * 8) * {NPROBE}", "round(m / c * 8)", "m * 8192", "0", "0", f"{NPROBE} * (m // c) * 8192"),
    "tiptoe": (f"c * {8 * DIM}", "largest * 8", "largest * 8", "largest * 16384", "41943040", "ceil(largest / 2048.0) * 163840", "largest * 16384"),
}


def _sizes(spark, d):
    return corpus(spark, d).groupBy(F.col("label").alias("cid")).agg(F.count(F.lit(1)).alias("n"))


def _register_cost(scheme: str) -> None:
    columns = ", ".join(f"({x})::BIGINT AS {name}" for x, name in zip(_COST_SQL[scheme], costs.FIELDS, strict=True))

    @query(f"cost_{scheme.replace('-', '_')}", f"WITH {_SIZES} SELECT '{scheme}' AS scheme, {columns} FROM t")
    def cost(spark, d):
        return costs.analytical(scheme, _sizes(spark, d), DIM, K, NPROBE)


for _scheme in costs.SCHEMES:
    _register_cost(_scheme)

_LABEL_ROUTE = f"{_C0}, {_Q}, r AS (SELECT qid, cid, (row_number() OVER (PARTITION BY qid ORDER BY list_distance(q, centroid), cid))::INTEGER AS pos FROM q CROSS JOIN c0), {_SIZES}"
_REALISED_SQL = {"plaintext": (f"least({K}, n) * 8", f"n * {4 * DIM}"), "sap-ivf": (f"least({K}, n) * 8", f"n * {4 * DIM}"), "emvp-ivf": ("n * 608", "n * 10336"), "bntm-ivf": ("n * 8", "n * 8192")}


def _register_realised(scheme: str) -> None:
    r, e = _REALISED_SQL[scheme]

    @query(
        f"realised_cost_{scheme.replace('-', '_')}",
        f"WITH {_LABEL_ROUTE} SELECT qid, sum({r})::BIGINT AS response_bytes, (sum({r}) // count(*))::BIGINT AS cluster_response_bytes, sum({e})::BIGINT AS effective_bytes FROM r JOIN s USING (cid) WHERE pos <= 3 GROUP BY qid",
    )
    def realised(spark, d):
        routes = ivf.route(asks(spark, d), ivf.label_centroids(corpus(spark, d)), 3)
        return costs.realised(scheme, routes, _sizes(spark, d), DIM, K)


for _scheme in _REALISED_SQL:
    _register_realised(_scheme)
