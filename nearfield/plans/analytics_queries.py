"""Queries of the results layer, over projections of the driver tables that stand for measurement rows and runs.

The projections are expressions that Spark and DuckDB read alike, so each is stated once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import text as t
from nearfield.operators import analytics as a
from nearfield.plans.registry import query, table
from nearfield.plans.vector_queries import rounded

RAW = {
    "event_id": "event_id",
    "scheme": "event_type",
    "qp": "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END",
    "query_id": "user_id",
    "latency_ms": "value",
    "recall": "CAST((user_id * 37) % 40 + (event_id % 5) * 15 AS DOUBLE) / 100",
    "device": "CASE WHEN event_id % 2 = 0 THEN 'cpu' ELSE 'gpu' END",
    "batch_size": "CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 1 ELSE 64 END",
    "threads": "CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END",
    "eff_bytes": "(event_id % 5) * 1000 + user_id",
    "state": "CASE WHEN event_id % 6 < 4 THEN 'on' ELSE 'off' END",
    "verify_ms": "value / 4",
    "substep": "CASE event_id % 7 WHEN 0 THEN 'route' WHEN 1 THEN 'encode' WHEN 2 THEN 'server-compute' WHEN 3 THEN 'verify' WHEN 4 THEN 'decompress' WHEN 5 THEN 'decode' ELSE 'merge' END",
    "config_label": "CONCAT('beta=0.', CAST(event_id % 3 * 25 AS STRING), '00|nprobe=', CAST(event_id % 9 AS STRING))",
}
RUNS = {
    "run_id": "o_orderkey",
    "machine_id": "CONCAT('m', CAST(o_custkey % 7 AS STRING))",
    "scheme": "o_orderpriority",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'partial' END",
    "sweep_size": "o_custkey % 5",
    "device": "CASE WHEN o_orderkey % 2 = 0 THEN 'cpu' ELSE 'gpu' END",
    "features": "CASE WHEN o_custkey % 3 = 0 THEN 'avx2,avx512f' ELSE 'avx2' END",
    "threads": "o_custkey % 11 + 1",
    "cache_hit": "o_orderkey % 4 <> 0",
    "build_s": "o_totalprice",
    "n_centroids": "o_custkey % 3 + 10",
    "started_at": "o_orderdate",
}


def raw(spark, d):
    return table(spark, d, "events").selectExpr(*[f"{x} AS {c}" for c, x in RAW.items()])


def runs(spark, d):
    return table(spark, d, "orders").selectExpr(*[f"{x} AS {c}" for c, x in RUNS.items()])


_RAW = "raw AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in RAW.items()) + " FROM events)"
_RUNS = "runs AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in RUNS.items()) + " FROM orders)"


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _stats(by: str) -> str:
    return f"""stats AS (SELECT {by}, n, queries, recall, mean, p50, p95, p99, CASE WHEN n > queries THEN sqrt(ss / (n - queries)) ELSE 0 END AS rep_std,
  CASE WHEN n > queries THEN sqrt(ss / (n - queries)) ELSE 0 END / sqrt(n) AS rep_se, CASE WHEN n > queries THEN sqrt(ss / (n - queries)) ELSE 0 END / sqrt(n) * 1.96 AS ci95
  FROM (SELECT {by}, count(*) AS n, count(DISTINCT query_id) AS queries, avg(recall) AS recall, avg(latency_ms) AS mean, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
  quantile_cont(latency_ms, 0.99) AS p99, sum(res * res) AS ss FROM (SELECT *, latency_ms - avg(latency_ms) OVER (PARTITION BY {by}, query_id) AS res FROM raw) GROUP BY {by}))"""


_S = _stats("scheme, qp")
_FIVE = ("recall", "mean", "p50", "p95", "p99", "rep_std", "rep_se", "ci95")


@query("rep_latency_stats", f"WITH {_RAW}, {_S} SELECT scheme, qp, n, queries, {_r(*_FIVE)} FROM stats")
def rep_latency_stats(spark, d):
    return rounded(a.repetition_stats(raw(spark, d), ["scheme", "qp"]), *_FIVE)


@query("recall_latency", f"WITH {_RAW}, {_S} SELECT scheme, qp, {_r('recall', 'mean', 'p50', 'p95')} FROM stats")
def recall_latency(spark, d):
    s = a.repetition_stats(raw(spark, d), ["scheme", "qp"]).select("scheme", "qp", "recall", "mean", "p50", "p95")
    return rounded(s, "recall", "mean", "p50", "p95")


@query("recall_throughput", f"WITH {_RAW}, {_S} SELECT scheme, qp, round(recall, 6) AS recall, round(1000 / mean, 6) AS qps, round(greatest(0, 1000 / mean - ci95 * 1000 / (mean * mean)), 6) AS qps_low, round(1000 / mean + ci95 * 1000 / (mean * mean), 6) AS qps_high FROM stats")
def recall_throughput(spark, d):
    s = a.throughput(a.repetition_stats(raw(spark, d), ["scheme", "qp"])).select("scheme", "qp", "recall", "qps", "qps_low", "qps_high")
    return rounded(s, "recall", "qps", "qps_low", "qps_high")


@query("throughput_panels", f"WITH {_RAW}, {_stats('scheme, device, qp')} SELECT scheme, device, qp, round(1000 / mean, 6) AS qps FROM stats WHERE scheme IN ('click', 'view')")
def throughput_panels(spark, d):
    s = a.throughput(a.repetition_stats(raw(spark, d).where(F.col("scheme").isin("click", "view")), ["scheme", "device", "qp"]))
    return rounded(s.select("scheme", "device", "qp", "qps"), "qps")


@query("recall_effective_bytes", f"WITH {_RAW} SELECT scheme, qp, round(avg(recall), 6) AS recall, round(avg(eff_bytes), 6) AS eff_bytes FROM raw GROUP BY scheme, qp HAVING avg(eff_bytes) > 0")
def recall_effective_bytes(spark, d):
    s = raw(spark, d).groupBy("scheme", "qp").agg(F.avg("recall").alias("recall"), F.avg("eff_bytes").alias("eff_bytes")).where("eff_bytes > 0")
    return rounded(s, "recall", "eff_bytes")


@query("recall_nprobe", f"WITH {_RAW} SELECT qp, round(avg(recall), 6) AS recall, count(*) AS n FROM raw WHERE device = 'cpu' AND batch_size = 1 GROUP BY qp")
def recall_nprobe(spark, d):
    s = raw(spark, d).where("device = 'cpu' AND batch_size = 1").groupBy("qp").agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n"))
    return rounded(s, "recall")


_DEV = f"{_stats('device, scheme, qp')}"


@query(
    "cpu_vs_gpu_outer",
    f"WITH {_RAW}, c AS (SELECT qp, avg(latency_ms) AS m FROM raw WHERE device = 'cpu' AND scheme = 'view' AND qp < 8 GROUP BY qp), g AS (SELECT qp, avg(latency_ms) AS m FROM raw WHERE device = 'gpu' AND scheme = 'view' AND qp > 1 GROUP BY qp) "
    "SELECT coalesce(c.qp, g.qp) AS qp, round(c.m, 6) AS cpu_mean, round(g.m, 6) AS gpu_mean FROM c FULL OUTER JOIN g ON c.qp = g.qp",
)
def cpu_vs_gpu_outer(spark, d):
    x = raw(spark, d).where("scheme = 'view'")
    m = lambda df: df.groupBy("qp").agg(F.avg("latency_ms").alias("mean"))
    return rounded(a.side_by_side(m(x.where("device = 'cpu' AND qp < 8")), m(x.where("device = 'gpu' AND qp > 1")), "qp", ("cpu", "gpu"), "mean"), "cpu_mean", "gpu_mean")


@query("gpu_only_schemes", f"WITH {_RAW} SELECT DISTINCT scheme FROM raw WHERE device = 'gpu' AND scheme NOT IN (SELECT scheme FROM raw WHERE device = 'cpu' AND query_id < 2 AND scheme <> 'click')")
def gpu_only_schemes(spark, d):
    """A set difference of distinct keys."""
    x = raw(spark, d)
    return x.where("device = 'gpu'").select("scheme").distinct().join(x.where("device = 'cpu' AND query_id < 2 AND scheme <> 'click'").select("scheme").distinct(), "scheme", "left_anti")


_CDF = "(SELECT scheme, latency_ms, row_number() OVER (PARTITION BY scheme ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY scheme) AS n FROM {src})"
_GRID = "n <= 500 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(500)) AS j) g WHERE (g.j * (c.n - 1)) // 499 = c.rn - 1)"


@query(
    "latency_cdf_small",
    f"WITH {_RAW} SELECT scheme, query_id, latency_ms, round(rn / n, 6) AS cdf FROM (SELECT scheme, query_id, latency_ms, row_number() OVER (PARTITION BY scheme, query_id ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY scheme, query_id) AS n FROM raw) c WHERE {_GRID}",
)
def latency_cdf_small(spark, d):
    """Distributions of few values each: all their points."""
    return rounded(a.distribution(raw(spark, d), ["scheme", "query_id"], "latency_ms"), "cdf")


@query("latency_cdf_500", f"WITH {_RAW} SELECT scheme, latency_ms, round(rn / n, 6) AS cdf FROM {_CDF.format(src='raw')} c WHERE {_GRID}")
def latency_cdf_500(spark, d):
    return rounded(a.distribution(raw(spark, d), ["scheme"], "latency_ms"), "cdf")


@query("latency_cdf_stepped", f"WITH {_RAW} SELECT scheme, latency_ms, round(rn / n, 6) AS cdf FROM {_CDF.format(src='raw')} WHERE (rn - 1) % greatest(1, n // 500) = 0 OR rn = n")
def latency_cdf_stepped(spark, d):
    return rounded(a.stepped_distribution(raw(spark, d), ["scheme"], "latency_ms"), "cdf")


_OP = "op AS (SELECT scheme, CASE WHEN max(recall) >= 0.5 THEN arg_min(qp, (mean, qp)) FILTER (WHERE recall >= 0.5) ELSE arg_min(qp, (-recall, qp)) END AS qp FROM stats GROUP BY scheme)"


@query("cdf_operating_point", f"WITH {_RAW}, {_S}, {_OP} SELECT scheme, qp FROM op")
def cdf_operating_point(spark, d):
    return a.operating_point(a.repetition_stats(raw(spark, d), ["scheme", "qp"]), ["scheme"], 0.5)


@query("closest_operating_point", f"WITH {_RAW}, {_S} SELECT scheme, arg_min(qp, (abs(recall - 0.45), qp)) AS qp FROM stats GROUP BY scheme")
def closest_operating_point(spark, d):
    return a.closest_point(a.repetition_stats(raw(spark, d), ["scheme", "qp"]), ["scheme"], 0.45)


@query("cdf_summary", f"WITH {_RAW}, {_S}, {_OP} SELECT scheme, count(*) AS n, round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM raw JOIN op USING (scheme, qp) GROUP BY scheme")
def cdf_summary(spark, d):
    x = raw(spark, d)
    at = a.operating_point(a.repetition_stats(x, ["scheme", "qp"]), ["scheme"], 0.5)
    s = x.join(at, ["scheme", "qp"], "left_semi").groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean"), *a._percentiles("latency_ms"))
    return rounded(s, "mean", "p50", "p95", "p99")


@query("scalar_vs_simd_summary", f"WITH {_RUNS}, s AS (SELECT scheme, CASE WHEN list_contains(string_split(features, ','), 'avx512f') THEN 'simd' ELSE 'scalar' END AS isa, avg(build_s) AS mean FROM runs GROUP BY ALL) SELECT scheme, isa, round(mean, 4) AS mean, round(mean / max(CASE WHEN isa = 'scalar' THEN mean END) OVER (PARTITION BY scheme), 6) AS ratio FROM s")
def scalar_vs_simd_summary(spark, d):
    from pyspark.sql.window import Window

    s = runs(spark, d).groupBy("scheme", a.isa(F.split("features", ",")).alias("isa")).agg(F.avg("build_s").alias("mean"))
    base = F.max(F.when(F.col("isa") == "scalar", F.col("mean"))).over(Window.partitionBy("scheme"))
    return rounded(rounded(s.withColumn("ratio", F.col("mean") / base), "ratio"), "mean", digits=4)


_NEAR8 = "arg_min(qp, (abs(r - 0.5), qp))"


@query(
    "batch_throughput",
    f"WITH {_RAW}, m AS (SELECT scheme, qp, avg(recall) AS r FROM raw GROUP BY ALL), p AS (SELECT scheme, {_NEAR8} AS qp FROM m GROUP BY scheme) "
    "SELECT scheme, batch_size, count(*) AS n, round(1000 * batch_size / avg(latency_ms), 6) AS qps, round(1000 * batch_size * stddev_samp(latency_ms) / (avg(latency_ms) * avg(latency_ms)) / sqrt(count(*)) * 1.96, 6) AS ci95 FROM raw JOIN p USING (scheme, qp) GROUP BY scheme, batch_size",
)
def batch_throughput(spark, d):
    """At the setting nearest the target recall, throughput by batch size with the error carried through the reciprocal."""
    x = raw(spark, d)
    at = a.closest_point(x.groupBy("scheme", "qp").agg(F.avg("recall").alias("recall")), ["scheme"], 0.5)
    s = a.mean_spread(x.join(at, ["scheme", "qp"], "left_semi"), ["scheme", "batch_size"], "latency_ms")
    rate = F.lit(1000.0) * F.col("batch_size")
    return rounded(s.select("scheme", "batch_size", "n", (rate / F.col("mean")).alias("qps"), (rate * F.col("ci95") / (F.col("mean") * F.col("mean"))).alias("ci95")), "qps", "ci95")


@query("amortised_batches", f"WITH {_RAW} SELECT event_id, (floor(latency_ms * 1000)::BIGINT // batch_size)::BIGINT AS amortised_us FROM raw WHERE batch_size > 1")
def amortised_batches(spark, d):
    return raw(spark, d).where("batch_size > 1").select("event_id", F.expr("CAST(floor(latency_ms * 1000) AS BIGINT) div batch_size").alias("amortised_us"))


@query("beta_recall", f"WITH {_RAW}, g AS (SELECT max(recall) AS plain FROM raw WHERE qp = 16) SELECT qp, count(*) AS n, round(avg(recall), 6) AS mean, round(stddev_samp(recall) / sqrt(count(*)) * 1.96, 6) AS ci95, round(max(g.plain), 6) AS plain FROM raw, g GROUP BY qp")
def beta_recall(spark, d):
    """Mean recall by noise, beside the largest recall without noise, one value that joins every row."""
    x = raw(spark, d)
    plain = x.where("qp = 16").agg(F.max("recall").alias("plain"))
    s = a.mean_spread(x, ["qp"], "recall").select("qp", "n", "mean", "ci95")
    return rounded(s.join(F.broadcast(plain)), "mean", "ci95", "plain")


@query("communication_summary", f"WITH {_RAW} SELECT scheme, arg_min(eff_bytes, event_id) AS eff_bytes, arg_min(batch_size, event_id) AS batch_size, arg_min(eff_bytes, event_id) + arg_min(batch_size, event_id) AS total FROM raw GROUP BY scheme")
def communication_summary(spark, d):
    s = a.first_by(raw(spark, d), ["scheme"], ["eff_bytes", "batch_size"], ["event_id"])
    return s.withColumn("total", F.col("eff_bytes") + F.col("batch_size")).orderBy(F.desc("total"), "scheme")


@query("communication_by_class", f"WITH {_RAW} SELECT CASE WHEN scheme IN ('click', 'view') THEN 'ivf' ELSE 'flat' END AS class, count(DISTINCT scheme) AS schemes, sum(eff_bytes)::BIGINT AS eff_bytes FROM raw GROUP BY ALL")
def communication_by_class(spark, d):
    kind = F.when(F.col("scheme").isin("click", "view"), "ivf").otherwise("flat").alias("class")
    return raw(spark, d).groupBy(kind).agg(F.count_distinct("scheme").alias("schemes"), F.sum("eff_bytes").alias("eff_bytes"))


_PICK = "row_number() OVER (PARTITION BY {by} ORDER BY (status = 'complete') DESC, sweep_size DESC, run_id DESC) = 1"


@query("select_latest_complete_run", f"WITH {_RUNS} SELECT machine_id, scheme, device, run_id, status FROM runs QUALIFY {_PICK.format(by='machine_id, scheme, device')}")
def select_latest_complete_run(spark, d):
    return a.latest_complete(runs(spark, d), ["machine_id", "scheme", "device"]).select("machine_id", "scheme", "device", "run_id", "status")


@query("select_by_features", f"WITH {_RUNS} SELECT machine_id, scheme, features, run_id FROM runs QUALIFY {_PICK.format(by='machine_id, scheme, features')}")
def select_by_features(spark, d):
    return a.latest_complete(runs(spark, d), ["machine_id", "scheme", "features"]).select("machine_id", "scheme", "features", "run_id")


@query("select_verified_run", f"WITH {_RUNS}, v AS (SELECT machine_id FROM runs GROUP BY machine_id HAVING max(build_s) > 400000) SELECT machine_id, cache_hit, run_id FROM runs WHERE status = 'complete' AND machine_id IN (SELECT machine_id FROM v) QUALIFY {_PICK.format(by='machine_id, cache_hit')}")
def select_verified_run(spark, d):
    """Complete runs by variant, of machines whose largest value is above a bound."""
    r = runs(spark, d)
    seen = r.groupBy("machine_id").agg(F.max("build_s").alias("most")).where("most > 400000").select("machine_id")
    return a.latest_complete(r.where("status = 'complete'").join(seen, "machine_id", "left_semi"), ["machine_id", "cache_hit"]).select("machine_id", "cache_hit", "run_id")


@query("select_breakdown_run", f"WITH {_RUNS} SELECT machine_id, scheme, run_id FROM runs WHERE sweep_size > 0 QUALIFY {_PICK.format(by='machine_id, scheme')}")
def select_breakdown_run(spark, d):
    return a.latest_complete(runs(spark, d).where("sweep_size > 0"), ["machine_id", "scheme"]).select("machine_id", "scheme", "run_id")


@query("latest_cold_build", f"WITH {_RUNS} SELECT scheme, machine_id, max(run_id) AS run_id, round(arg_max(build_s, run_id), 4) AS build_s FROM runs WHERE NOT cache_hit GROUP BY scheme, machine_id")
def latest_cold_build(spark, d):
    s = runs(spark, d).where("NOT cache_hit").groupBy("scheme", "machine_id").agg(F.max("run_id").alias("run_id"), F.max_by("build_s", "run_id").alias("build_s"))
    return rounded(s, "build_s", digits=4)


@query("active_ivf_key", f"WITH {_RUNS} SELECT run_id, n_centroids FROM runs WHERE n_centroids = (SELECT arg_max(n_centroids, run_id) FROM runs)")
def active_ivf_key(spark, d):
    return a.active_key(runs(spark, d), "n_centroids").select("run_id", "n_centroids")


@query("latest_machine", f"WITH {_RUNS} SELECT arg_max(machine_id, run_id) AS machine_id, max(run_id) AS run_id FROM runs WHERE status = 'complete'")
def latest_machine(spark, d):
    return runs(spark, d).where("status = 'complete'").agg(F.max_by("machine_id", "run_id").alias("machine_id"), F.max("run_id").alias("run_id"))


@query("latest_by_start", f"WITH {_RUNS} SELECT scheme, arg_max(run_id, (started_at, run_id)) AS run_id FROM runs GROUP BY scheme")
def latest_by_start(spark, d):
    return runs(spark, d).groupBy("scheme").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


_WIDE = ", ".join(f"coalesce(avg(CASE WHEN substep = '{s}' THEN latency_ms * 1000 END), 0) AS \"{s}\"" for s in a.SUBSTEPS)
_TOTAL = " + ".join(f'"{s}"' for s in a.SUBSTEPS)


@query("substep_pivot", f"WITH {_RAW}, w AS (SELECT scheme, {_WIDE} FROM raw WHERE NOT (scheme = 'view' AND substep = 'verify') GROUP BY scheme) SELECT scheme, " + ", ".join(f'round("{s}", 4) AS "{s}"' for s in a.SUBSTEPS) + f", round({_TOTAL}, 4) AS total FROM w")
def substep_pivot(spark, d):
    long = raw(spark, d).where("NOT (scheme = 'view' AND substep = 'verify')").withColumn("us", F.col("latency_ms") * 1000)
    return rounded(a.substep_means(long), *a.SUBSTEPS, "total", digits=4)


@query("substep_normalised", f"WITH {_RAW}, w AS (SELECT scheme, {_WIDE} FROM raw GROUP BY scheme) SELECT scheme, " + ", ".join(f'round("{s}" / ({_TOTAL}), 6) AS "{s}"' for s in a.SUBSTEPS) + " FROM w")
def substep_normalised(spark, d):
    wide = a.substep_means(raw(spark, d).withColumn("us", F.col("latency_ms") * 1000))
    return rounded(a.fractions(wide.drop("total"), list(a.SUBSTEPS)), *a.SUBSTEPS)


@query("substep_long", f"WITH {_RAW} SELECT event_id, step, round(latency_ms * share, 6) AS ms FROM raw CROSS JOIN (VALUES ('route', 0.25), ('decode', 0.25), ('merge', 0.5)) v(step, share)")
def substep_long(spark, d):
    """One measured row as a row for each of its steps."""
    x = raw(spark, d)
    step = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(s).alias("share")) for n, s in (("route", 0.25), ("decode", 0.25), ("merge", 0.5))])).alias("s")
    return x.select("event_id", "latency_ms", step).select("event_id", "s.step", F.round(F.col("latency_ms") * F.col("s.share"), 6).alias("ms"))


_PAR = "s AS (SELECT scheme, threads, avg(latency_ms) AS mean FROM raw {w} GROUP BY scheme, threads), b AS (SELECT *, count(*) OVER (PARTITION BY scheme) AS points, max(CASE WHEN threads = 1 THEN mean END) OVER (PARTITION BY scheme) AS base FROM s)"


@query("parallel_efficiency", f"WITH {_RAW}, {_PAR.format(w='')} SELECT scheme, threads, round(mean, 6) AS mean, round(base / mean, 6) AS speedup, round(base / mean / threads, 6) AS efficiency FROM b WHERE points >= 2")
def parallel_efficiency(spark, d):
    return rounded(a.parallel_scaling(raw(spark, d), ["scheme"]), "mean", "speedup", "efficiency")


@query(
    "parallel_efficiency_pinned",
    f"WITH {_RAW}, s AS (SELECT scheme, device = 'cpu' AS pinned, threads, avg(latency_ms) AS mean FROM raw WHERE NOT (device = 'gpu' AND threads = 1) GROUP BY ALL), b AS (SELECT *, count(*) OVER (PARTITION BY scheme, pinned) AS points, max(CASE WHEN threads = 1 AND pinned THEN mean END) OVER (PARTITION BY scheme) AS base FROM s) "
    "SELECT scheme, pinned, threads, round(mean, 6) AS mean, round(base / mean, 6) AS speedup, round(base / mean / threads, 6) AS efficiency FROM b WHERE points >= 2",
)
def parallel_efficiency_pinned(spark, d):
    """Bound and unbound threads against one bound thread."""
    x = raw(spark, d).where("NOT (device = 'gpu' AND threads = 1)").withColumn("pinned", F.col("device") == "cpu")
    return rounded(a.parallel_scaling(x, ["scheme"], pinned="pinned"), "mean", "speedup", "efficiency")


_ONE_T = "WHERE scheme <> 'click' OR threads = 2"


@query("scaling_min_two_threads", f"WITH {_RAW}, {_PAR.format(w=_ONE_T)} SELECT DISTINCT scheme FROM b WHERE points >= 2")
def scaling_min_two_threads(spark, d):
    """A scheme with one thread count is left out."""
    return a.parallel_scaling(raw(spark, d).where("scheme <> 'click' OR threads = 2"), ["scheme"]).select("scheme").distinct()


@query(
    "verify_on_off",
    f"WITH {_RAW}, r AS (SELECT * FROM raw WHERE NOT (state = 'on' AND (scheme = 'signup' OR qp = 4))), shared AS (SELECT DISTINCT scheme, qp FROM r WHERE state = 'on'), "
    "o AS (SELECT scheme, avg(latency_ms) AS on_mean, avg(verify_ms) AS verify_mean FROM r WHERE state = 'on' GROUP BY scheme), "
    "f AS (SELECT scheme, avg(latency_ms) AS off_mean FROM r WHERE state = 'off' AND ((scheme, qp) IN (SELECT scheme, qp FROM shared) OR scheme NOT IN (SELECT scheme FROM shared)) GROUP BY scheme) "
    "SELECT f.scheme, round(off_mean, 6) AS off_mean, round(on_mean, 6) AS on_mean, round(verify_mean, 6) AS verify_mean, round(CASE WHEN on_mean IS NULL THEN 0 ELSE greatest(0, on_mean - verify_mean - off_mean) END, 6) AS side_effect FROM f LEFT JOIN o ON o.scheme = f.scheme",
)
def verify_on_off(spark, d):
    x = raw(spark, d).where("NOT (state = 'on' AND (scheme = 'signup' OR qp = 4))")
    return rounded(a.verification_cost(x), "off_mean", "on_mean", "verify_mean", "side_effect")


_MACHINES = [f"m{i}" for i in range(7)]


@query("coverage_matrix", f"WITH {_RUNS} SELECT scheme, " + ", ".join(f"count(*) FILTER (WHERE machine_id = '{m}') AS {m}" for m in _MACHINES) + " FROM runs GROUP BY scheme")
def coverage_matrix(spark, d):
    return a.coverage(runs(spark, d), "scheme", "machine_id", _MACHINES)


@query(
    "machine_summary",
    f"WITH {_RUNS} SELECT machine_id, count(*) AS runs, min(started_at) AS first_run, max(started_at) AS last_run, list_aggregate(list_sort(list(DISTINCT scheme)), 'string_agg', ',') AS schemes, "
    "CASE WHEN min(threads) = max(threads) THEN min(threads)::STRING ELSE concat(min(threads)::STRING, '-', max(threads)::STRING) END AS threads FROM runs GROUP BY machine_id",
)
def machine_summary(spark, d):
    return runs(spark, d).groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("first_run"), F.max("started_at").alias("last_run"),
        F.array_join(F.array_sort(F.collect_set("scheme")), ",").alias("schemes"), a.range_text(F.min("threads"), F.max("threads")).alias("threads"),
    )


@query("machine_names", f"WITH {_RUNS}, n AS (SELECT concat('m', (n_nationkey * 2)::STRING) AS machine_id, n_name AS name FROM nation) SELECT run_id, coalesce(name, 'unknown') AS name FROM runs LEFT JOIN n USING (machine_id)")
def machine_names(spark, d):
    """A dimension joined on the left, with a placeholder where it lacks the key."""
    n = table(spark, d, "nation").select(F.concat(F.lit("m"), (F.col("n_nationkey") * 2).cast("string")).alias("machine_id"), F.col("n_name").alias("name"))
    return runs(spark, d).join(n, "machine_id", "left").select("run_id", F.coalesce("name", F.lit("unknown")).alias("name"))


@query("sha_warnings", f"WITH {_RUNS} SELECT machine_id, device, count(DISTINCT n_centroids) AS n FROM runs GROUP BY machine_id, device HAVING count(DISTINCT n_centroids) > 1")
def sha_warnings(spark, d):
    return runs(spark, d).groupBy("machine_id", "device").agg(F.count_distinct("n_centroids").alias("n")).where("n > 1")


@query(
    "gate_overlap",
    f"WITH {_RAW}, x AS (SELECT qp, avg(recall) AS ra FROM raw WHERE device = 'cpu' GROUP BY qp), y AS (SELECT qp, avg(recall) AS rb FROM raw WHERE device = 'gpu' GROUP BY qp), "
    "o AS (SELECT qp, count(*) / 150.0 AS overlap FROM (SELECT DISTINCT qp, query_id FROM raw WHERE device = 'cpu' INTERSECT SELECT DISTINCT qp, query_id FROM raw WHERE device = 'gpu') GROUP BY qp) "
    "SELECT bool_and(abs(ra - rb) <= 0.02 AND overlap >= 0.8) AS passed, count(*) AS configs, count(*) FILTER (WHERE abs(ra - rb) <= 0.02 AND overlap >= 0.8) AS within FROM x JOIN y USING (qp) JOIN o USING (qp)",
)
def gate_overlap(spark, d):
    from nearfield.operators.knn import overlap

    x = raw(spark, d)
    side = lambda dev: x.where(F.col("device") == dev)
    m = lambda dev, c: side(dev).groupBy("qp").agg(F.avg("recall").alias(c))
    ids = lambda dev: side(dev).select("qp", F.col("query_id").alias("vec_id")).distinct()
    return a.gate(m("cpu", "recall_a").join(m("gpu", "recall_b"), "qp").join(overlap(ids("cpu"), ids("gpu"), 150, ["qp"]), "qp"))


@query(
    "interp_qps_at_recall",
    f"WITH {_RAW}, p AS (SELECT scheme, qp, avg(recall) AS recall, 1000 / avg(latency_ms) AS qps FROM raw GROUP BY ALL), l AS (SELECT *, lag(recall) OVER w AS x0, lag(qps) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY scheme ORDER BY recall, qps)) "
    "SELECT scheme, round(CASE WHEN min(recall) >= 0.5 THEN arg_min(qps, (recall, qps)) WHEN max(recall) < 0.5 THEN arg_max(qps, (recall, qps)) ELSE max(CASE WHEN x0 < 0.5 AND recall >= 0.5 THEN y0 + (0.5 - x0) * (qps - y0) / (recall - x0) END) END, 6) AS qps FROM l GROUP BY scheme",
)
def interp_qps_at_recall(spark, d):
    p = raw(spark, d).groupBy("scheme", "qp").agg(F.avg("recall").alias("recall"), (F.lit(1000.0) / F.avg("latency_ms")).alias("qps"))
    return rounded(a.interpolated(p, ["scheme"], 0.5), "qps")


@query("upsert_missing_rows", "SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::BIGINT AS score FROM nation WHERE n_nationkey < 15 UNION ALL SELECT s_suppkey, s_name, s_suppkey % 7 FROM supplier WHERE s_suppkey >= 15")
def upsert_missing_rows(spark, d):
    """Rows of the second table whose key the first lacks are appended; its extra column is null for the first."""
    old = table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7).alias("score"))
    return a.upsert_missing(old, new, ["id"])


@query("schema_union_backfill", "SELECT event_id, 'cpu' AS device, 0::BIGINT AS eff, 1 AS batch_size, event_id * 3 AS wallclock_us, round(event_id * 3 / 1000.0, 6) AS latency_ms FROM events")
def schema_union_backfill(spark, d):
    """Rows of the oldest form, with hyphens and without later columns."""
    old = table(spark, d, "events").select("event_id", (F.col("event_id") * 3).alias("latency-us"))
    b = a.backfilled(old)
    return b.select("event_id", "device", F.col("effective_bytes_per_query").alias("eff"), "batch_size", "wallclock_us", F.round("latency_ms", 6).alias("latency_ms"))


@query("cleanup_reason", f"WITH {_RUNS} SELECT run_id, CASE WHEN status <> 'complete' THEN 'incomplete-status' WHEN sweep_size = 0 THEN 'missing' WHEN threads = 1 THEN 'empty' END AS reason FROM runs WHERE status <> 'complete' OR sweep_size = 0 OR threads = 1")
def cleanup_reason(spark, d):
    reason = a.cleanup_reason(F.col("status"), F.col("sweep_size") > 0, F.col("threads") > 1)
    return runs(spark, d).select("run_id", reason.alias("reason")).where("reason IS NOT NULL")


@query("manifest_state", "SELECT concat('f', p_partkey::STRING) AS name, CASE p_partkey % 5 WHEN 0 THEN 'unlisted' WHEN 1 THEN 'absent' WHEN 2 THEN 'changed' ELSE 'same' END AS state FROM part")
def manifest_state(spark, d):
    """A manifest that lacks a fifth of the files, and files of which another fifth is missing and one has grown."""
    p, kind = table(spark, d, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name")), F.col("p_partkey") % 5
    digest = F.sha2("name", 256).alias("sha256")
    stated = p.where(kind != 0).select("name", digest, F.col("p_partkey").alias("bytes"))
    local = p.where(kind != 1).select("name", digest, (F.col("p_partkey") + F.when(kind == 2, 1).otherwise(0)).alias("bytes"))
    return a.manifest_state(stated, local)


@query("config_label_parse", f"WITH {_RAW} SELECT event_id, regexp_extract(config_label, 'nprobe=([0-9]+)', 1)::BIGINT AS nprobe, split_part(split_part(config_label, '|', 1), '=', 2) AS beta, CASE WHEN event_id % 3 = 0 THEN '0' WHEN event_id % 3 = 1 THEN '0.25' ELSE '0.5' END AS short FROM raw")
def config_label_parse(spark, d):
    pairs = t.label_pairs(F.col("config_label"))
    return raw(spark, d).select("event_id", t.label_number(F.col("config_label"), "nprobe").alias("nprobe"), pairs["beta"].alias("beta"), t.strip_zeros(pairs["beta"]).alias("short"))


@query("config_label_build", f"WITH {_RAW} SELECT event_id, printf('beta=%.4f|nprobe=%d', qp / 16.0, qp) AS label FROM raw WHERE NOT contains(config_label, 'beta=') OR contains(config_label, 'beta=0.000')")
def config_label_build(spark, d):
    plain = ~F.contains("config_label", F.lit("beta=")) | F.contains("config_label", F.lit("beta=0.000"))
    return raw(spark, d).where(plain).select("event_id", t.beta_label(F.col("qp") / 16.0, F.col("qp")).alias("label"))


@query("slugify", "SELECT o_orderkey, trim(regexp_replace(lower(concat(o_orderpriority, ' / ', o_orderstatus, '!')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM orders")
def slugify(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.slug(F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit("!"))).alias("slug"))


@query("dedupe_by_slug", "SELECT slug, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM orders) GROUP BY slug")
def dedupe_by_slug(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("first_key"), t.slug(F.col("o_orderpriority")).alias("slug"))
    return a.latest(o, ["slug"], [F.col("first_key")]).select("slug", "first_key")


@query("iso8601", "SELECT event_id, strftime(make_timestamp((1700000000 + event_id * 3607) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso8601(spark, d):
    return table(spark, d, "events").select("event_id", t.iso_utc(F.col("event_id") * 3607 + 1700000000).alias("iso"))


@query("snapshot_key", f"WITH {_RUNS}, l AS (SELECT device, scheme, max(run_id) AS run_id FROM runs GROUP BY device, scheme) SELECT device, substr(sha256(list_aggregate(list_sort(list(concat(scheme, '=', run_id::STRING))), 'string_agg', '|')), 1, 12) AS key FROM l GROUP BY device")
def snapshot_key(spark, d):
    newest = runs(spark, d).groupBy("device", "scheme").agg(F.max("run_id").alias("run_id"))
    return newest.groupBy("device").agg(t.snapshot_key(F.col("scheme"), F.col("run_id")).alias("key"))


@query("valid_campaigns", "SELECT o_orderkey, regexp_full_match(o_orderpriority, '[A-Za-z0-9._:-]{1,128}') AS valid FROM orders")
def valid_campaigns(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.valid_campaign(F.col("o_orderpriority")).alias("valid"))


@query("humane_latency", "SELECT event_id, CASE WHEN us < 1000 THEN printf('%.0f us', us::DOUBLE) WHEN us < 1000000 THEN printf('%.2f ms', us / 1000.0) ELSE printf('%.2f s', us / 1000000.0) END AS shown FROM (SELECT event_id, (event_id * event_id * 20)::BIGINT AS us FROM events)")
def humane_latency(spark, d):
    return table(spark, d, "events").select("event_id", t.humane_micros(F.col("event_id") * F.col("event_id") * 20).alias("shown"))


@query("passage_prefix", "SELECT doc_id, concat('passage: ', text) AS passage FROM documents")
def passage_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("passage: "), "text").alias("passage"))


@query("malformed_rows_dropped", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def malformed_rows_dropped(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k IS NOT NULL AND k >= 50")


@query("peek_first_row", f"WITH {_RAW} SELECT query_id, arg_min(scheme, event_id) AS scheme, arg_min(qp, event_id) AS qp FROM raw GROUP BY query_id")
def peek_first_row(spark, d):
    """What the first row of each file says."""
    first = F.min_by(F.struct("scheme", "qp"), "event_id").alias("f")
    return raw(spark, d).groupBy("query_id").agg(first).select("query_id", "f.scheme", "f.qp")


@query("header_only_files", "SELECT o_custkey AS file FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def header_only_files(spark, d):
    """Files without a row."""
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("file")).distinct()
    return files.join(table(spark, d, "events").select(F.col("user_id").alias("file")).distinct(), "file", "left_anti")


@query("bench_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(avg(l_discount), 6) AS avg_disc, round(quantile_cont(l_extendedprice, 0.95), 2) AS p95_price, count(*) AS n FROM lineitem GROUP BY ALL")
def bench_pricing(spark, d):
    """The statistics of a large measurement table, for benchmarks."""
    x = table(spark, d, "lineitem")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.round(F.percentile("l_extendedprice", 0.95), 2).alias("p95_price"), F.count(F.lit(1)).alias("n"))


_INTERP = "round(CASE WHEN min(recall) >= 0.5 THEN arg_min(qps, (recall, qps)) WHEN max(recall) < 0.5 THEN arg_max(qps, (recall, qps)) ELSE max(CASE WHEN x0 < 0.5 AND recall >= 0.5 THEN y0 + (0.5 - x0) * (qps - y0) / (recall - x0) END) END, 6)"


@query(
    "cpu_vs_gpu_table",
    f"WITH {_RAW}, p AS (SELECT device, scheme, qp, avg(recall) AS recall, 1000 / avg(latency_ms) AS qps FROM raw GROUP BY ALL), l AS (SELECT *, lag(recall) OVER w AS x0, lag(qps) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY device, scheme ORDER BY recall, qps)), "
    f"i AS (SELECT device, scheme, {_INTERP} AS qps FROM l GROUP BY device, scheme) SELECT coalesce(c.scheme, g.scheme) AS scheme, c.qps AS cpu_qps, g.qps AS gpu_qps, round(g.qps / c.qps, 4) AS ratio FROM (SELECT * FROM i WHERE device = 'cpu') c FULL OUTER JOIN (SELECT * FROM i WHERE device = 'gpu') g ON c.scheme = g.scheme",
)
def cpu_vs_gpu_table(spark, d):
    """Throughput at one recall on both devices, side by side."""
    p = raw(spark, d).groupBy("device", "scheme", "qp").agg(F.avg("recall").alias("recall"), (F.lit(1000.0) / F.avg("latency_ms")).alias("qps"))
    at = rounded(a.interpolated(p, ["device", "scheme"], 0.5), "qps")
    both = a.side_by_side(at.where("device = 'cpu'"), at.where("device = 'gpu'"), "scheme", ("cpu", "gpu"), "qps")
    return rounded(both.withColumn("ratio", F.col("gpu_qps") / F.col("cpu_qps")), "ratio", digits=4)


@query("cross_machine_latency", f"WITH {_RUNS} SELECT machine_id, device, threads, count(*) AS runs, round(avg(build_s), 4) AS mean, round(median(build_s), 4) AS p50 FROM runs WHERE status = 'complete' GROUP BY machine_id, device, threads")
def cross_machine_latency(spark, d):
    s = runs(spark, d).where("status = 'complete'").groupBy("machine_id", "device", "threads").agg(F.count(F.lit(1)).alias("runs"), F.avg("build_s").alias("mean"), F.percentile("build_s", 0.5).alias("p50"))
    return rounded(s, "mean", "p50", digits=4)


@query("build_time_summary", f"WITH {_RUNS}, c AS (SELECT scheme, machine_id, max(run_id) AS run_id, arg_max(build_s, run_id) AS build_s FROM runs WHERE NOT cache_hit AND status = 'complete' GROUP BY scheme, machine_id) SELECT scheme, count(*) AS machines, round(min(build_s), 4) AS fastest, round(max(build_s), 4) AS slowest, arg_min(machine_id, (build_s, machine_id)) AS machine_id FROM c GROUP BY scheme")
def build_time_summary(spark, d):
    cold = runs(spark, d).where("NOT cache_hit AND status = 'complete'").groupBy("scheme", "machine_id").agg(F.max_by("build_s", "run_id").alias("build_s"))
    s = cold.groupBy("scheme").agg(F.count(F.lit(1)).alias("machines"), F.min("build_s").alias("fastest"), F.max("build_s").alias("slowest"), F.min_by("machine_id", F.struct("build_s", "machine_id")).alias("machine_id"))
    return rounded(s, "fastest", "slowest", digits=4)


@query("run_inventory", f"WITH {_RUNS} SELECT scheme, status, count(*) AS runs, count(DISTINCT machine_id) AS machines, max(run_id) AS newest, strftime(max(started_at), '%Y-%m-%d %H:%M') AS last_start FROM runs GROUP BY scheme, status")
def run_inventory(spark, d):
    return runs(spark, d).groupBy("scheme", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("machine_id").alias("machines"), F.max("run_id").alias("newest"), F.substring(F.max("started_at").cast("string"), 1, 16).alias("last_start")
    )


@query("reservoir_sample", "SELECT doc_id, lang FROM documents ORDER BY ((doc_id + 42) * 2654435761) % 4294967296, doc_id LIMIT 25")
def reservoir_sample(spark, d):
    """An exact number of passages, the same whenever and wherever it is drawn; all if there are no more."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.orderBy(((F.col("doc_id") + 42) * F.lit(2654435761)) % F.lit(4294967296), "doc_id").limit(25)


@query("local_times", "SELECT event_id, strftime(make_timestamp((1700000000 + event_id * 3607) * 1000000) AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M') AS shown FROM events")
def local_times(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", t.local_display(t.iso_utc(F.col("event_id") * 3607 + 1700000000), "Asia/Tokyo").alias("shown"))


@query("effective_bytes_dropped", f"WITH {_RAW} SELECT scheme, count(*) AS n FROM raw WHERE eff_bytes <> 0 GROUP BY scheme")
def effective_bytes_dropped(spark, d):
    """Rows without effective bytes are no measurement."""
    return raw(spark, d).where("eff_bytes <> 0").groupBy("scheme").agg(F.count(F.lit(1)).alias("n"))


_FILES = "f AS (SELECT run_id, status, concat('f', run_id % 4) AS name, CASE WHEN run_id % 7 <> 3 THEN sha256(concat('x', run_id)) END AS here, CASE WHEN run_id % 5 = 1 THEN sha256(concat('y', run_id)) WHEN run_id % 5 IN (2, 3) THEN sha256(concat('x', run_id)) END AS there FROM runs)"


@query(
    "transfer_plan",
    f"WITH {_RUNS}, {_FILES} SELECT run_id, name, CASE WHEN here IS NULL THEN 'hydrate' WHEN there = here THEN 'prune' WHEN there IS NOT NULL THEN 'conflict' WHEN status = 'complete' THEN 'upload' ELSE 'refuse' END AS action FROM f WHERE here IS NOT NULL OR there IS NOT NULL",
)
def transfer_plan(spark, d):
    """What becomes of each file of a run between the local tree and the store."""
    r = runs(spark, d)
    digest = lambda p: F.sha2(F.concat(F.lit(p), F.col("run_id").cast("string")), 256).alias("sha256")
    name = F.concat(F.lit("f"), (F.col("run_id") % 4).cast("string")).alias("name")
    same, other = r.where("run_id % 5 IN (2, 3)").select("run_id", name, digest("x")), r.where("run_id % 5 = 1").select("run_id", name, digest("y"))
    return a.transfer_plan(r.where("run_id % 7 <> 3").select("run_id", name, digest("x")), same.unionByName(other), r)
