"""The tree of run results: measurement files, metadata documents and registries.

``runs/<machine>/<revision>/<run>/<file>``: the path has the keys, and metadata is joined on them.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.analytics import backfilled
from nearfield.session import ship, write_document

RAW_SCHEMA = """run_id string, scheme string, quality_param_name string, quality_param double, config_label string, k int, query_id long, recall_at_k double,
latency_us long, query_bytes long, response_bytes long, cluster_response_bytes long, setup_bytes long, pre_query_offline_up_bytes long, pre_query_offline_down_bytes long,
verification_overhead_us long, machine_id string, device string, effective_bytes_per_query long, batch_size int, wallclock_us long, amortised_latency_us long"""
TOP_K_SCHEMA = "config_label string, query_id long, rank int, doc_id long, score float"
SUBSTEP_SCHEMA = "run_id string, scheme string, quality_param_name string, quality_param double, config_label string, query_id long, substep string, us long, machine_id string"
MACHINE_SCHEMA = "machine_id string, machine_name string, cpu_model string, cores int, ram_bytes long, os string, kernel_version string, cpu_governor string, gpu_kind string"
INDEX_SCHEMA = "run_id string, machine_id string, git_sha string, git_dirty boolean, scheme string, dataset string, started_at timestamp, duration_secs long, status string, path string"
#: What is read of a metadata document: column, type, place in the document, default.
METADATA = (
    ("status", "string", "status", "complete"),
    ("git_sha", "string", "git-sha", None),
    ("device", "string", "device", "cpu"),
    ("breakdown", "boolean", "breakdown", False),
    ("target_features", "array<string>", "target-features", []),
    ("parallel_threads", "int", "parallel-threads", None),
    ("numactl_binding", "string", "numactl-binding", None),
    ("duration_secs", "long", "duration-secs", None),
    ("n_centroids", "int", "ivf.n-centroids", None),
    ("train_seed", "long", "ivf.train-seed", None),
    ("max_iter", "int", "ivf.max-iter", None),
    ("cache_hit", "boolean", "index.cache-hit", None),
    ("build_secs", "double", "index.build-duration-secs", None),
    ("scheme", "string", "scheme-config.scheme", None),
    ("verification_enabled", "boolean", "scheme-config.verification-enabled", False),
    ("nprobe_values", "array<int>", "scheme-config.nprobe-values", []),
    ("beta_values", "array<double>", "scheme-config.beta-values", []),
    ("n_passages", "long", "dataset.n-passages", None),
)


def with_path_keys(df: DataFrame) -> DataFrame:
    """Adds machine, revision and run from each row's file."""
    path = F.col("_metadata.file_path")
    part = lambda n: F.regexp_extract(path, "([^/]+)/([^/]+)/([^/]+)/[^/]+$", n)
    return df.select("*", part(1).alias("path_machine"), part(2).alias("path_sha"), part(3).alias("path_run"))


def _csv(spark: SparkSession, root: str | list[str], name: str, schema: str) -> DataFrame:
    """All files of a name under a root. Columns are found by the header, which may have hyphens or lack later columns."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("mode", "DROPMALFORMED")
    return reader.schema(schema).csv(root)


def read_raw(spark: SparkSession, root: str, name: str = "raw.csv", runs: DataFrame | None = None) -> DataFrame:
    """All rows under a root, or those of ``runs`` (path_machine, path_sha, path_run) alone, whose folders are the only ones that are listed and read."""
    if runs is None:
        return with_path_keys(_csv(spark, root, name, RAW_SCHEMA))
    picked = runs.select("path_machine", "path_sha", "path_run").distinct().collect()  # a catalogue's filter leaves few runs
    if not picked:
        return with_path_keys(_csv(spark, root, name, RAW_SCHEMA)).limit(0)
    return with_path_keys(_csv(spark, [f"{root}/{r[0]}/{r[1]}/{r[2]}" for r in picked], name, RAW_SCHEMA))


def read_legacy_raw(spark: SparkSession, path: str) -> DataFrame:
    """Files of an older header, typed by the present schema and filled with its defaults."""
    types = {c.split()[0]: c.split()[1] for c in RAW_SCHEMA.replace("\n", " ").split(", ")}
    df = backfilled(spark.read.option("header", True).csv(path))
    return df.withColumns({c: F.col(c).try_cast(types[c]) for c in df.columns if c in types})


def read_substeps(spark: SparkSession, root: str) -> DataFrame:
    return with_path_keys(_csv(spark, root, "substep-breakdown.csv", SUBSTEP_SCHEMA))


def read_top_k(spark: SparkSession, root: str) -> DataFrame:
    return with_path_keys(_csv(spark, root, "top_k.csv", TOP_K_SCHEMA))


def read_machines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(MACHINE_SCHEMA).csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(INDEX_SCHEMA).csv(path)


def _at(doc: dict, place: str):
    for key in place.split("."):
        doc = doc.get(key) if isinstance(doc, dict) else None
    return doc


def read_metadata(spark: SparkSession, root: str, name: str = "run-metadata.toml") -> DataFrame:
    """A row for each metadata document, with defaults; a document that does not parse has status ``unreadable``."""
    ship(spark)
    docs = with_path_keys(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["value"]:
                try:
                    doc = tomllib.loads(text)
                except tomllib.TOMLDecodeError:
                    doc = {"status": "unreadable"}
                rows.append(json.dumps({c: default if (v := _at(doc, place)) is None else v for c, _, place, default in METADATA}, default=str))
            yield b[["path_machine", "path_sha", "path_run"]].assign(doc=rows)

    parsed = docs.mapInPandas(parse, "path_machine string, path_sha string, path_run string, doc string")
    schema = ", ".join(f"{c} {kind}" for c, kind, _, _ in METADATA)
    keys = ["path_machine", "path_sha", "path_run"]
    return parsed.select(*keys, F.from_json("doc", schema).alias("d")).select(*keys, "d.*").withColumn("sweep_size", F.greatest(F.lit(1), F.size("nprobe_values")) * F.greatest(F.lit(1), F.size("beta_values")))


def with_metadata(rows: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their run; runs are few and Spark broadcasts them if they fit."""
    keys = ["path_machine", "path_sha", "path_run"]
    return rows.join(runs.select(*keys, *columns), keys, "left")


def read_interop(spark: SparkSession, timing: str, out: str) -> tuple[DataFrame, DataFrame]:
    """The timing rows and the hits that an out-of-process cross-check leaves."""
    read = spark.read.option("header", True)
    t = "query_id long, encode_us long, upload_us long, server_us long, download_us long, decode_us long, total_us long"
    return read.schema(t).csv(timing), read.schema("query_id long, rank int, doc_id long, score double").csv(out)


def write_interop(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """One line for each vector, its components parted by commas, in the order of the ids."""
    vectors.orderBy(id_col).select(F.array_join(F.transform(vector_col, lambda x: x.cast("string")), ",").alias("value")).write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_raw(df: DataFrame, path: str) -> None:
    """CSV with a header, recall to six digits, and nothing for null."""
    cols = [F.when(F.col(c).isNotNull(), F.format_string("%.6f", c)).alias(c) if c == "recall_at_k" else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("append").option("header", True).option("nullValue", "").csv(path)


def write_top_k(df: DataFrame, path: str) -> None:
    """Hits in the columns of a top_k file, scores as floats."""
    write_raw(df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TOP_K_SCHEMA.split(", ")]), path)


def write_substeps(df: DataFrame, path: str) -> None:
    """Steps in the columns of a substep-breakdown file."""
    write_raw(df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SUBSTEP_SCHEMA.split(", ")]), path)


def to_toml(doc: dict, under: str = "") -> str:
    """A document of nested tables, whose values are texts, numbers, booleans, times and lists of them; nulls are left out."""
    own = [f"{k} = {_toml(v)}" for k, v in doc.items() if v is not None and not isinstance(v, dict)]
    tables = [(f"{under}{k}", v) for k, v in doc.items() if isinstance(v, dict)]
    return "\n".join([*own, *(f"\n[{name}]\n{to_toml(v, name + '.')}" for name, v in tables)])


def _toml(v) -> str:
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(_toml, v)) + "]"
    if isinstance(v, float):
        return repr(v) if v == v and abs(v) != float("inf") else "nan" if v != v else "inf" if v > 0 else "-inf"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return json.dumps(v)


def write_metadata(spark: SparkSession, path: str, doc: dict) -> None:
    """Writes a run's metadata document; a reader sees the one before or this one, and never part of it."""
    write_document(spark, path, to_toml(doc) + "\n")


def write_tsv(df: DataFrame, path: str, digits: dict[str, int] | None = None, missing: str = "nan") -> None:
    """One tab-separated file for a figure; such relations are small."""
    cols = [F.when(F.col(c).isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{digits[c]}f", c)).alias(c) if digits and c in digits else F.col(c) for c in df.columns]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", missing).csv(path)


def append_missing(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key the table at the path lacks, and says how many."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(*key), key, "left_anti")
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    return n
