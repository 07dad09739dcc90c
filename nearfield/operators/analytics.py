"""Relations over measurement rows: repetition statistics, operating points, distributions, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.vectors import clamped, guarded_ratio

Z95 = 1.96


def _percentiles(x: str) -> list[Column]:
    return [F.percentile(x, q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)]


def repetition_stats(raw: DataFrame, by: list[str], value: str = "latency_ms", query: str = "query_id") -> DataFrame:
    """Latency by group over repeated queries: the spread is that of repetitions around each query's own mean.

    Partial sums by query are summed again by group, and percentiles join them, so rows are never shuffled one by one. Percentiles are exact
    and hold a group's distinct values, whose number the clock's resolution bounds.
    """
    rows = raw.where(F.col(value).isNotNull())
    each = rows.groupBy(*by, query).agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    s = each.groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("queries"), weighted("recall").alias("recall"), weighted("mean").alias("mean"), F.sum("ss").alias("ss"))
    s = s.withColumnRenamed("rows", "n").join(rows.groupBy(*by).agg(*_percentiles(value)), by)
    dof = F.col("n") - F.col("queries")
    s = s.withColumn("rep_std", F.when(dof > 0, F.sqrt(F.col("ss") / dof)).otherwise(0.0)).drop("ss")
    return s.withColumn("rep_se", F.col("rep_std") / F.sqrt("n")).withColumn("ci95", F.col("rep_se") * Z95)


def throughput(stats: DataFrame) -> DataFrame:
    """Queries a second from mean latency in ms, with the bounds of its interval; never under zero."""
    half = guarded_ratio(F.col("ci95") * 1000.0, F.col("mean") * F.col("mean"))
    qps = guarded_ratio(F.lit(1000.0), F.col("mean"))
    return stats.withColumn("qps", qps).withColumn("qps_low", clamped(qps - half)).withColumn("qps_high", qps + half)


def mean_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, standard error and half-width of the 95 % interval by group."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return s.withColumn("se", F.col("std") / F.sqrt("n")).withColumn("ci95", F.col("se") * Z95)


def operating_point(stats: DataFrame, by: list[str], target: float, qp: str = "qp") -> DataFrame:
    """The fastest setting whose recall reaches the target, else the one of the highest recall; ties to the smaller setting."""
    fast = F.min_by(qp, F.struct(F.when(F.col("recall") >= target, F.lit(0)).otherwise(F.lit(1)), "mean", qp))
    return stats.groupBy(*by).agg(F.when(F.max("recall") >= target, fast).otherwise(F.min_by(qp, F.struct(-F.col("recall"), qp))).alias(qp))


def closest_point(stats: DataFrame, by: list[str], target: float, qp: str = "qp") -> DataFrame:
    """The setting whose recall is nearest the target; ties to the smaller setting."""
    return stats.groupBy(*by).agg(F.min_by(qp, F.struct(F.abs(F.col("recall") - target), qp)).alias(qp))


def _value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, lo, hi, total): the ranks, from 1, that the rows of each distinct value take. Windows see values, not rows."""
    h = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    h = h.withColumn("hi", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    return h.withColumn("lo", F.col("hi") - F.col("n") + 1)


def _at_ranks(ranks: DataFrame, by: list[str], value: str, picked: Column) -> DataFrame:
    return ranks.withColumn("rank", F.explode(picked)).select(*by, value, (F.col("rank") / F.col("total")).alias("cdf"))


def distribution(df: DataFrame, by: list[str], value: str, most: int = 500) -> DataFrame:
    """(by..., value, cdf): the sorted values and their share; beyond ``most`` rows that many, evenly spread with both ends.

    The j-th of them has rank (j * (total - 1)) div (most - 1) + 1; the js of a value's ranks form a range.
    """
    first = f"((lo - 1) * {most - 1} + total - 2) div (total - 1)"
    last = f"least({most - 1}, (hi * {most - 1} + total - 2) div (total - 1) - 1)"
    some = f"CASE WHEN {first} <= {last} THEN transform(sequence({first}, {last}), j -> (j * (total - 1)) div {most - 1} + 1) ELSE CAST(array() AS array<bigint>) END"
    return _at_ranks(_value_ranks(df, by, value), by, value, F.expr(f"CASE WHEN total <= {most} THEN sequence(lo, hi) ELSE {some} END"))


def stepped_distribution(df: DataFrame, by: list[str], value: str, most: int = 500) -> DataFrame:
    """Every (total div most)-th sorted value, and the last."""
    step = f"greatest(1, total div {most})"
    first, last = f"((lo - 1 + {step} - 1) div {step})", f"((hi - 1) div {step})"
    some = f"CASE WHEN {first} <= {last} THEN transform(sequence({first}, {last}), k -> k * {step} + 1) ELSE CAST(array() AS array<bigint>) END"
    return _at_ranks(_value_ranks(df, by, value), by, value, F.expr(f"array_union({some}, CASE WHEN hi = total THEN array(total) ELSE CAST(array() AS array<bigint>) END)"))


def interpolated(points: DataFrame, by: list[str], target: float, x: str = "recall", y: str = "qps") -> DataFrame:
    """y where x reaches the target, on straight lines between points by x; the end's y beyond the ends."""
    w = Window.partitionBy(*by).orderBy(x, y)
    p = points.select(*by, x, y).withColumn("x0", F.lag(x).over(w)).withColumn("y0", F.lag(y).over(w))
    between = (F.col("x0") < target) & (F.col(x) >= target)
    at = F.col("y0") + (F.lit(target) - F.col("x0")) * (F.col(y) - F.col("y0")) / (F.col(x) - F.col("x0"))
    inside = F.max(F.when(between, at))
    first, last = F.min_by(y, F.struct(x, y)), F.max_by(y, F.struct(x, y))
    return p.groupBy(*by).agg(F.coalesce(F.when(F.min(x) >= target, first).when(F.max(x) < target, last), inside).alias(y))


def side_by_side(a: DataFrame, b: DataFrame, on: str, names: tuple[str, str], value: str) -> DataFrame:
    """Both sides by key, either possibly null."""
    left, right = (df.select(on, F.col(value).alias(f"{n}_{value}")) for df, n in ((a, names[0]), (b, names[1])))
    return left.join(right, on, "full_outer")


def first_by(df: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Each column's first non-null value in a stated order."""
    return df.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as shares of their row's total; null counts as zero, and so does a share of nothing."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return df.withColumns({c: guarded_ratio(F.coalesce(F.col(c), F.lit(0.0)), total) for c in columns})


SUBSTEPS = ("route", "encode", "server-compute", "verify", "decompress", "decode", "merge")


def substep_means(long: DataFrame, by: str = "scheme") -> DataFrame:
    """Long rows (by, substep, us) as one mean for each canonical substep, zero where there are none, and their total."""
    wide = long.groupBy(by).pivot("substep", list(SUBSTEPS)).agg(F.avg("us")).fillna(0.0, list(SUBSTEPS))
    return wide.withColumn("total", sum((F.col(f"`{s}`") for s in SUBSTEPS), F.lit(0.0)))


def parallel_scaling(df: DataFrame, by: list[str], value: str = "latency_ms", pinned: str | None = None) -> DataFrame:
    """Mean by threads, with speed-up and efficiency against one thread; only groups of at least two thread counts.

    pinned: a boolean column that says whether threads were bound; means are then by it too, and the baseline is that of one bound thread for all.
    """
    own = [pinned] if pinned else []
    s = df.groupBy(*by, *own, "threads").agg(F.avg(value).alias("mean"))
    one = (F.col("threads") == 1) & (F.col(pinned) if pinned else F.lit(True))
    base = F.max(F.when(one, F.col("mean"))).over(Window.partitionBy(*by))
    points = F.count(F.lit(1)).over(Window.partitionBy(*by, *own))
    s = s.withColumn("points", points).withColumn("speedup", base / F.col("mean")).withColumn("efficiency", base / F.col("mean") / F.col("threads"))
    return s.where("points >= 2").drop("points")


def verification_cost(df: DataFrame, value: str = "latency_ms", verify: str = "verify_ms") -> DataFrame:
    """On and off runs by scheme over the settings that both have; all off rows where there is no on run.

    What verification costs is its own time, the rest of the difference is a side effect.
    """
    on, off = df.where("state = 'on'"), df.where("state = 'off'")
    shared = on.select("scheme", "qp").distinct()
    some = shared.select("scheme").distinct()
    matched = off.join(shared, ["scheme", "qp"], "left_semi").unionByName(off.join(some, "scheme", "left_anti"), allowMissingColumns=True)
    a = on.groupBy("scheme").agg(F.avg(value).alias("on_mean"), F.avg(verify).alias("verify_mean"))
    b = matched.groupBy("scheme").agg(F.avg(value).alias("off_mean"))
    both = b.join(a, "scheme", "left")
    compute = F.col("on_mean") - F.col("verify_mean")
    baseline = F.coalesce("off_mean", compute)
    return both.select("scheme", "off_mean", "on_mean", "verify_mean", clamped(compute - baseline).alias("side_effect"))


def gate(pairs: DataFrame, recall_gap: float = 0.02, least_overlap: float = 0.80) -> DataFrame:
    """One row: whether every configuration is within the recall gap and the overlap, and how many are."""
    ok = (F.abs(F.col("recall_a") - F.col("recall_b")) <= recall_gap) & (F.col("overlap") >= least_overlap)
    return pairs.agg(F.every(ok).alias("passed"), F.count(F.lit(1)).alias("configs"), F.count_if(ok).alias("within"))


# Runs


def latest(runs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One run for each key: the first in the order. An early limit keeps a hot key small before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return runs.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def latest_complete(runs: DataFrame, by: list[str]) -> DataFrame:
    """The latest complete run of each key, of the widest sweep first; the latest of any status if none is complete."""
    return latest(runs, by, [(F.col("status") == "complete").desc(), F.col("sweep_size").desc(), F.col("run_id").desc()])


def isa(features: Column) -> Column:
    return F.when(F.array_contains(features, "avx512f"), "simd").otherwise("scalar")


def active_key(runs: DataFrame, key: str, run_id: str = "run_id") -> DataFrame:
    """The rows that have the key of the latest run."""
    return runs.join(runs.agg(F.max_by(key, run_id).alias(key)), key, "left_semi")


def require_one(df: DataFrame, *columns: str) -> None:
    """Raises where rows differ in columns that must agree."""
    n = df.agg(F.count_distinct(*columns)).first()[0]
    if n > 1:
        raise ValueError(f"{n} different values of {', '.join(columns)} must not be combined")


def coverage(runs: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of runs by two keys as a matrix; the values of the second are stated, so no pass looks for them."""
    return runs.groupBy(rows).pivot(columns, values).count().fillna(0)


def range_text(low: Column, high: Column) -> Column:
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def upsert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there; columns of either are kept."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def backfilled(df: DataFrame) -> DataFrame:
    """Measurement rows of any age in the present form: hyphens as underscores, missing columns with their defaults."""
    df = df.toDF(*[c.replace("-", "_") for c in df.columns])
    have = set(df.columns)
    null = F.lit(None)
    old = lambda c: F.col(c) if c in have else null
    defaults = {
        "device": F.lit("cpu"), "effective_bytes_per_query": F.lit(0).cast("long"), "batch_size": F.lit(1), "wallclock_us": old("latency_us").cast("long"),
        "amortised_latency_us": old("latency_us").cast("long"), "pre_query_offline_up_bytes": old("pre_query_offline_bytes").cast("long"), "pre_query_offline_down_bytes": F.lit(0).cast("long"),
    }
    df = df.withColumns({c: F.coalesce(F.col(c), d) if c in have else d for c, d in defaults.items()})
    return df.withColumns({f"{c}_ms": F.col(f"{c}_us") / 1000.0 for c in ("latency", "wallclock", "amortised_latency")})


def cleanup_reason(status: Column, has_file: Column, has_rows: Column) -> Column:
    return F.when(status != "complete", "incomplete-status").when(~has_file, "missing").when(~has_rows, "empty")


def manifest_state(manifest: DataFrame, local: DataFrame) -> DataFrame:
    """(name, state): same, changed, absent or unlisted, of stated files (name, sha256, bytes) against local ones."""
    m = manifest.select("name", F.col("sha256").alias("sha_m"), F.col("bytes").alias("bytes_m"))
    j = m.join(local.select("name", F.col("sha256").alias("sha_l"), F.col("bytes").alias("bytes_l")), "name", "full_outer")
    state = F.when(F.col("bytes_l").isNull(), "absent").when(F.col("bytes_m").isNull(), "unlisted").when((F.col("sha_m") == F.col("sha_l")) & (F.col("bytes_m") == F.col("bytes_l")), "same")
    return j.select("name", state.otherwise("changed").alias("state"))


def transfer_plan(local: DataFrame, store: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, name, action) for each file of local(run_id, name, sha256) or store(run_id, name, sha256).

    Only files of complete runs(run_id, status) are admitted to the store: ``upload`` what it lacks, ``conflict`` where digests differ, ``refuse`` files of
    other runs. What the store has alone is to ``hydrate``, what both have alike may be pruned locally: ``prune``.
    """
    l, s = local.select("run_id", "name", F.col("sha256").alias("here")), store.select("run_id", "name", F.col("sha256").alias("there"))
    both = l.join(s, ["run_id", "name"], "full").join(runs.select("run_id", "status"), "run_id", "left")
    action = (
        F.when(F.col("here").isNull(), "hydrate")
        .when(F.col("there") == F.col("here"), "prune")
        .when(F.col("there").isNotNull(), "conflict")
        .when(F.col("status").eqNullSafe(F.lit("complete")), "upload")
        .otherwise("refuse")
    )
    return both.select("run_id", "name", action.alias("action"))
