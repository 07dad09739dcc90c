"""Evaluation sweeps: settings x batch sizes x repetitions, with recall, latency, costs, verification and the steps of a search."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import costs, ivf, knn, schemes
from nearfield.session import materialise, remove_at_exit, scratch_dir
from nearfield.sources.run_tree import RAW_SCHEMA, SUBSTEP_SCHEMA

SUBSTEPS = ("route", "encode", "server-compute", "verify", "decompress", "decode", "merge")


@dataclass(frozen=True)
class Setting:
    """One configuration: a scheme, the index whose postings it has encoded, and how many clusters are probed."""

    scheme: object
    index: ivf.Index
    nprobe: int
    name: str
    value: float
    verify: bool = False

    @property
    def label(self) -> str:
        return f"{self.name}={self.value:g}"

    @property
    def cost_name(self) -> str:
        routed = f"{self.scheme.name}-ivf"
        return routed if routed in costs.SCHEMES else self.scheme.name

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.search(queries, k, self.nprobe, self.scheme)

    def check(self, queries: DataFrame) -> int:
        """Microseconds that verification of the routed clusters takes; 0 if the setting has none. A wrong answer is refused."""
        if not self.verify:
            return 0
        began = time.perf_counter()
        schemes.require_verified(self.scheme.verify(self.index.postings, queries, routes=ivf.route(queries, self.index.centroids, self.nprobe)))
        return _since(began)


def _since(began: float) -> int:
    return int((time.perf_counter() - began) * 1e6)


def nprobe_settings(index: ivf.Index, nprobes: tuple[int, ...], scheme=None, verify: bool = False) -> list[Setting]:
    """A setting for each number of probed clusters, on one encoded index."""
    scheme = scheme or ivf.Plain()
    own = index if isinstance(scheme, ivf.Plain) else index.encoded(scheme)
    return [Setting(scheme, own, n, "nprobe", n, verify) for n in nprobes]


def chunks(queries: DataFrame, n: int, size: int) -> list[DataFrame]:
    """Whole batches of a size by query number; what is left over is dropped. qid counts from 0."""
    return [queries.where((F.col("qid") >= i * size) & (F.col("qid") < (i + 1) * size)) for i in range(n // size)]


def sweep(
    settings: list[Setting], queries: DataFrame, truth: DataFrame, k: int, batch_sizes: tuple[int, ...] = (1,), repetitions: int = 1, most: int | None = None, run_id: str = "run", machine_id: str = "local", device: str = "cpu"
) -> tuple[DataFrame, DataFrame]:
    """(raw, top_k): measurement rows with all columns of the results layer, and the hits of the first repetition of the first batch size.

    Each batch is one plan and one write of its hits by the executors; the driver keeps a batch's times and nothing else. A batch's
    wall-clock time is divided among its queries as whole microseconds; latency is null for batches of several.
    """
    spark = queries.sparkSession
    queries = queries if most is None else queries.where(F.col("qid") < most)
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    root = f"{scratch_dir(spark)}/nearfield-sweep-{uuid.uuid4().hex}"
    remove_at_exit(spark, root)
    timed = []
    for i, s in enumerate(settings):
        for size in batch_sizes:
            for rep in range(repetitions):
                for c, chunk in enumerate(chunks(queries, n, size)):
                    began = time.perf_counter()
                    s.search(chunk, k).select("qid", "rank", "vec_id", F.col("value").cast("double").alias("value")).write.parquet(f"{root}/setting={i}/size={size}/rep={rep}/chunk={c}")
                    timed.append((i, size, rep, c, _since(began), s.check(chunk) // size))
    keys = ["setting", "size", "rep"]
    times = spark.createDataFrame(timed, "setting int, size int, rep int, chunk long, us long, verify_us long")
    schema = "qid long, rank int, vec_id long, value double, setting int, size int, rep int, chunk int"
    hits = spark.read.schema(schema).parquet(root) if timed else spark.createDataFrame([], schema)
    wanted = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    got = hits.join(wanted, ["qid", "vec_id"]).groupBy(*keys, "qid").agg(F.count(F.lit(1)).alias("found"))
    rows = times.join(queries.select("qid"), F.floor(F.col("qid") / F.col("size")) == F.col("chunk"))
    rows = rows.join(wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("due")), "qid", "left").join(got, [*keys, "qid"], "left")
    rows = rows.join(_costs(spark, settings, dim or 0, k, queries), ["setting", "qid"], "left")
    amortised = F.expr("us div size")
    given = {
        "run_id": F.lit(run_id),
        "k": F.lit(k),
        "query_id": F.col("qid"),
        "recall_at_k": F.coalesce("found", F.lit(0)) / F.col("due"),
        "latency_us": F.when(F.col("size") == 1, F.col("us")),
        "verification_overhead_us": F.col("verify_us"),
        "machine_id": F.lit(machine_id),
        "device": F.lit(device),
        "batch_size": F.col("size"),
        "wallclock_us": F.col("us"),
        "amortised_latency_us": amortised,
    }
    columns = [x.split()[:2] for x in RAW_SCHEMA.replace("\n", " ").split(",")]
    raw = rows.select(*[(given[c] if c in given else F.col(c)).cast(t).alias(c) for c, t in columns])
    first = hits.where((F.col("size") == batch_sizes[0]) & (F.col("rep") == 0))
    labels = spark.createDataFrame([(i, s.label) for i, s in enumerate(settings)], "setting int, config_label string")
    top_k = first.join(labels, "setting").select("config_label", F.col("qid").alias("query_id"), (F.col("rank") - 1).alias("rank"), F.col("vec_id").alias("doc_id"), F.col("value").cast("float").alias("score"))
    return raw, top_k


def _costs(spark: SparkSession, settings: list[Setting], dim: int, k: int, queries: DataFrame) -> DataFrame:
    """(setting, qid, scheme, quality_param_name, quality_param, config_label, bytes...): by formulas, and by the clusters probed where a scheme's answer depends on them."""
    out = None
    for i, s in enumerate(settings):
        sizes = ivf.cluster_sizes(s.index.postings)
        stated = costs.analytical(s.cost_name, sizes, dim, k, s.nprobe).select(
            "query_bytes", "setup_bytes", F.col("offline_up_bytes").alias("pre_query_offline_up_bytes"), F.col("offline_down_bytes").alias("pre_query_offline_down_bytes"),
            F.col("response_bytes").alias("r"), F.col("cluster_response_bytes").alias("c"), F.col("effective_bytes").alias("e"),
        ).first()
        each = queries.select("qid")
        if s.cost_name in costs.REALISED:
            each = each.join(costs.realised(s.cost_name, ivf.route(queries, s.index.centroids, s.nprobe), sizes, dim, k), "qid", "left")
        else:
            each = each.withColumns({"response_bytes": F.lit(stated["r"]), "cluster_response_bytes": F.lit(stated["c"]), "effective_bytes": F.lit(stated["e"])})
        named = {"setting": F.lit(i), "scheme": F.lit(s.cost_name), "quality_param_name": F.lit(s.name), "quality_param": F.lit(float(s.value)), "config_label": F.lit(s.label)}
        bytes_ = {c: F.lit(stated[c]) for c in ("query_bytes", "setup_bytes", "pre_query_offline_up_bytes", "pre_query_offline_down_bytes")}
        each = each.withColumns(named | bytes_).withColumnRenamed("effective_bytes", "effective_bytes_per_query")
        out = each if out is None else out.unionByName(each)
    if out is None:
        names = "scheme string, quality_param_name string, quality_param double, config_label string, query_bytes long, setup_bytes long, pre_query_offline_up_bytes long, pre_query_offline_down_bytes long"
        return spark.createDataFrame([], f"setting int, qid long, {names}, response_bytes long, cluster_response_bytes long, effective_bytes_per_query long")
    return out


class Counters:
    """Microseconds and calls of each step over all executors, added up by accumulators."""

    def __init__(self, spark: SparkSession) -> None:
        self.spent_us = {s: spark.sparkContext.accumulator(0) for s in SUBSTEPS}
        self.calls = {s: spark.sparkContext.accumulator(0) for s in SUBSTEPS}

    def recorder(self):
        us, calls = self.spent_us, self.calls

        def spent(step: str, seconds: float) -> None:
            us[step].add(int(seconds * 1e6))
            calls[step].add(1)

        return spent

    def snapshot(self) -> dict[str, tuple[int, int]]:
        """(microseconds, calls) by step."""
        return {s: (self.spent_us[s].value, self.calls[s].value) for s in SUBSTEPS}


def delta(after: dict[str, tuple[int, int]], before: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    return {s: (us - before[s][0], n - before[s][1]) for s, (us, n) in after.items()}


def breakdown(setting: Setting, queries: DataFrame, k: int, run_id: str = "run", machine_id: str = "local") -> DataFrame:
    """The seven canonical steps of each query's search, in the columns of the results layer; a step that a scheme does not have is zero.

    Routing, encoding, verification and the merge are timed on the driver, what happens to postings where they lie.
    """
    spark = queries.sparkSession
    counters, rows, index = Counters(spark), [], setting.index
    for qids, q in knn.query_blocks(queries, setting.scheme.query_bytes):
        for qid, vector in zip(qids.tolist(), q, strict=True):
            us, before = dict.fromkeys(SUBSTEPS, 0), counters.snapshot()
            began = time.perf_counter()
            wanted = index.routes(vector[None], setting.nprobe)
            us["route"] = _since(began)
            began = time.perf_counter()
            asked = setting.scheme.asking(vector[None])
            us["encode"] = _since(began)
            found = materialise(ivf.answers(index.postings, np.array([qid]), wanted, asked, k, setting.scheme.value, counters.recorder()), "breakdown")
            for step, (spent, _) in delta(counters.snapshot(), before).items():
                us[step] += spent
            us["verify"] = setting.check(spark.createDataFrame([(qid, vector.tolist())], "qid long, embedding array<double>"))
            began = time.perf_counter()
            ivf.best_of(found, k, setting.scheme.ascending).collect()  # k rows
            us["merge"] = _since(began)
            rows += [(run_id, setting.cost_name, setting.name, float(setting.value), setting.label, qid, step, t, machine_id) for step, t in us.items()]
    return spark.createDataFrame(rows, SUBSTEP_SCHEMA)


@dataclass(frozen=True)
class FixedPoint:
    """Inner products of components rounded to a number of bits after the point."""

    bits: int
    name, value, ascending, held, query_bytes = "fixed-point", "long", False, "embedding", 0

    def encoded(self, postings: DataFrame) -> DataFrame:
        return postings

    def asking(self, q: np.ndarray) -> FixedPointQueries:
        return FixedPointQueries(self.bits, _rounded(q, self.bits))


def _rounded(x: np.ndarray, bits: int) -> np.ndarray:
    v = x * float(1 << bits)
    return np.copysign(np.floor(np.abs(v) + 0.5), v).astype(np.int64)


class FixedPointQueries(schemes.Asking):
    def __init__(self, bits: int, q: np.ndarray) -> None:
        self.bits, self.q = bits, q

    @property
    def steps(self) -> tuple:
        return (("server-compute", self._products),)

    def _products(self, part: pa.RecordBatch, at: np.ndarray, _) -> np.ndarray:
        return _rounded(knn.matrix(part.column("embedding")), self.bits) @ self.q[at].T


def bits_sweep(corpus: DataFrame, queries: DataFrame, k: int, bits: tuple[int, ...]) -> DataFrame:
    """(bits, qid, recall): how much a coarser fixed-point scale loses, against the exact inner product."""
    truth = materialise(knn.exact_knn(corpus, queries, k, "ip"), "truth")
    out = None
    for b in bits:
        r = knn.recall(schemes.top(FixedPoint(b), corpus, queries, k), truth, k).withColumn("bits", F.lit(b))
        out = r if out is None else out.unionByName(r)
    return out.select("bits", "qid", "recall")
