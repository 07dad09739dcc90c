"""Bytes that each scheme moves, from formulas over cluster sizes. All are one-row or per-query projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("query_bytes", "response_bytes", "cluster_response_bytes", "setup_bytes", "offline_up_bytes", "offline_down_bytes", "effective_bytes")
SCHEMES = ("plaintext", "sap", "sap-ivf", "emvp", "emvp-ivf", "bntm", "bntm-ivf", "tiptoe")
#: Schemes whose answers depend on the clusters that are probed.
REALISED = ("plaintext", "sap-ivf", "emvp-ivf", "bntm-ivf")
#: Encoded widths, blocks, secret entries and bytes of a compressed hint ciphertext.
EMVP_WIDTH, EMVP_BLOCKS, BN_WIDTH, LWE_ENTRIES, RING = 1292, 76, 1024, 2048, 2048
CIPHERTEXT = 2 * RING * 5


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def analytical(scheme: str, sizes: DataFrame, dim: int, k: int, nprobe: int) -> DataFrame:
    """The seven costs of a scheme, a row, from sizes(cid, n)."""
    s = sizes.agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("c"), F.max("n").alias("largest"))
    m, c, whole = F.col("m"), F.col("c"), F.floor(F.col("m") / F.col("c"))
    mean, zero = m / c, F.lit(0)
    hits = F.lit(8) * F.least(F.lit(k), whole)
    if scheme in ("plaintext", "sap-ivf"):
        row = [F.lit((4 if scheme == "plaintext" else 8) * dim), hits * nprobe, hits, zero, zero, zero, F.lit(nprobe * 4 * dim) * whole]
    elif scheme == "sap":
        row = [F.lit(8 * dim), F.lit(8 * k), F.lit(8 * k), zero, zero, zero, m * 4 * dim]
    elif scheme == "emvp":
        row = [F.lit(8 * EMVP_WIDTH), m * 8 * EMVP_BLOCKS, m * 8 * EMVP_BLOCKS, m * 8 * EMVP_WIDTH, zero, zero, m * 8 * EMVP_WIDTH]
    elif scheme == "emvp-ivf":
        per = _half_up(mean * (EMVP_BLOCKS * 8))
        row = [F.lit(8 * EMVP_WIDTH), per * nprobe, per, m * 8 * EMVP_WIDTH, zero, zero, _half_up(mean) * (nprobe * EMVP_WIDTH * 8)]
    elif scheme == "bntm":
        row = [F.lit(8 * BN_WIDTH), m * 8, m * 8, m * 8 * BN_WIDTH, zero, zero, m * 8 * BN_WIDTH]
    elif scheme == "bntm-ivf":
        per = _half_up(mean * 8)
        row = [F.lit(8 * BN_WIDTH), per * nprobe, per, m * 8 * BN_WIDTH, zero, zero, whole * (nprobe * BN_WIDTH * 8)]
    elif scheme == "tiptoe":
        top = F.col("largest")
        row = [c * 8 * dim, top * 8, top * 8, top * 8 * LWE_ENTRIES, F.lit(LWE_ENTRIES * CIPHERTEXT), F.ceil(top / RING) * 8 * CIPHERTEXT, top * 8 * LWE_ENTRIES]
    else:
        raise ValueError(f"scheme is one of {SCHEMES}")
    return s.select(F.lit(scheme).alias("scheme"), *[x.cast("long").alias(name) for x, name in zip(row, FIELDS, strict=True)])


def realised(scheme: str, routes: DataFrame, sizes: DataFrame, dim: int, k: int) -> DataFrame:
    """(qid, response_bytes, cluster_response_bytes, effective_bytes) of the clusters that each query probed."""
    probed = routes.select("qid", "cid").join(sizes, "cid").groupBy("qid")
    n = F.col("n")
    response, effective = {
        "plaintext": (F.least(F.lit(k), n) * 8, n * 4 * dim),
        "sap-ivf": (F.least(F.lit(k), n) * 8, n * 4 * dim),
        "emvp-ivf": (n * EMVP_BLOCKS * 8, n * EMVP_WIDTH * 8),
        "bntm-ivf": (n * 8, n * BN_WIDTH * 8),
    }[scheme]
    out = probed.agg(F.sum(response).alias("response_bytes"), F.count(F.lit(1)).alias("probed"), F.sum(effective).alias("effective_bytes"))
    return out.select("qid", "response_bytes", F.floor(F.col("response_bytes") / F.col("probed")).alias("cluster_response_bytes"), "effective_bytes")
