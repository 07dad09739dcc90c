"""Indexes on disk under a fingerprint of their parameters and of the corpus itself."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import ivf
from nearfield.session import exists, materialise, read_document, remove_at_exit, scratch_dir, write_document


def fingerprint(corpus: DataFrame, **params) -> str:
    """Hex digits that change with the parameters, the number of vectors or any of them; order does not matter."""
    row = F.xxhash64("vec_id", "embedding")
    n, low, high = corpus.agg(F.count(F.lit(1)), F.sum((row % 1000003).cast("decimal(38,0)")), F.bit_xor(row)).first()
    return hashlib.sha256(repr((sorted(params.items()), n, str(low), high)).encode()).hexdigest()[:16]


@dataclass
class Built:
    index: ivf.Index
    cache_hit: bool
    seconds: float


def own_root(spark: SparkSession) -> str:
    """A folder for indexes of this application, which goes with it."""
    path = f"{scratch_dir(spark)}/nearfield-indexes-{spark.sparkContext.applicationId}"
    remove_at_exit(spark, path)
    return path


def build_or_read(corpus: DataFrame, root: str, k: int | None = None, seed: int = 42, max_iter: int = 25, train: Callable[[], DataFrame] | None = None, **start) -> Built:
    """Reads the index of these parameters and vectors, or trains and writes it. Anything unreadable counts as a miss.

    train: centroids by another way than k-means; ``start`` names it for the fingerprint.
    """
    spark = corpus.sparkSession
    began = time.perf_counter()
    params = start if train else {"k": k, "seed": seed, "max_iter": max_iter}
    path = f"{root}/ivf-{fingerprint(corpus, **params)}"
    hit = exists(spark, f"{path}/postings/_SUCCESS")
    if not hit:
        centroids = materialise(train() if train else ivf.train(corpus, k=k, seed=seed, max_iter=max_iter), "centroids")
        ivf.write(ivf.Index(centroids, ivf.assign(corpus, centroids)), path)
    return Built(ivf.read(spark, path), hit, time.perf_counter() - began)


#: Layout of encoded indexes; another one is refused.
VERSION = 2


def write_encoded(scheme, index: ivf.Index, path: str) -> None:
    """Postings as a scheme has encoded them, with centroids and a document of what they are, which is written last."""
    spark = index.postings.sparkSession
    ivf.write(ivf.Index(index.centroids, scheme.encoded(index.postings)), path)
    counts = spark.read.parquet(f"{path}/postings").agg(F.count(F.lit(1)), F.count_distinct("cid")).first()
    meta = {"version": VERSION, "scheme": scheme.name, "params": _params(scheme), "vectors": counts[0], "clusters": counts[1]}
    write_document(spark, f"{path}/meta.json", json.dumps(meta, sort_keys=True))


def read_encoded(spark: SparkSession, scheme, path: str) -> ivf.Index:
    """The encoded index at the path. Another layout, scheme or parameter is refused, and so are counts that the files do not bear out."""
    meta = json.loads(read_document(spark, f"{path}/meta.json"))
    for key, want in (("version", VERSION), ("scheme", scheme.name), ("params", _params(scheme))):
        if meta.get(key) != want:
            raise ValueError(f"{path} has {key} {meta.get(key)}, not {want}")
    index = ivf.read(spark, path)
    vectors, clusters, widest, least = index.postings.agg(F.count(F.lit(1)), F.count_distinct("cid"), F.max(F.length(scheme.held)), F.min(F.length(scheme.held))).first()
    if (vectors, clusters) != (meta["vectors"], meta["clusters"]) or widest != least:
        raise ValueError(f"{path} holds {vectors} vectors of {clusters} clusters with {least} to {widest} bytes, not {meta['vectors']} of {meta['clusters']}")
    return index


def _params(scheme) -> dict:
    return json.loads(json.dumps(asdict(scheme)))


def build_or_read_encoded(scheme, index: ivf.Index, root: str) -> tuple[ivf.Index, bool]:
    """(encoded index, whether it was there) under the fingerprint of the scheme and the postings; what is unreadable is encoded again."""
    spark = index.postings.sparkSession
    path = f"{root}/{scheme.name}-{fingerprint(index.postings, scheme=scheme.name, **_params(scheme))}"
    if exists(spark, f"{path}/meta.json"):
        try:
            return read_encoded(spark, scheme, path), True
        except ValueError:
            pass
    write_encoded(scheme, index, path)
    return read_encoded(spark, scheme, path), False
