"""Passage and query files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_FILES = ("queries.tsv", "queries.dev.tsv", "queries.train.tsv")


def read_passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(pid, passage) of lines with a tab; later tabs belong to the passage, other lines are dropped."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("pid"), parts[1].alias("passage"))


def read_queries_tsv(spark: SparkSession, folder: str, names: tuple[str, ...] = QUERY_FILES) -> DataFrame:
    """(qid, query) of the first of the named files that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if p.getFileSystem(conf).exists(p):
            return read_passages_tsv(spark, f"{folder}/{name}").toDF("qid", "query")
    raise FileNotFoundError(f"none of {', '.join(names)} is in {folder}")


def read_passages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pid string, passage string").json(path)


def write_passages_jsonl(df: DataFrame, path: str) -> None:
    df.select("pid", "passage").write.mode("overwrite").json(path)


def prefixed(df: DataFrame, prefix: str, column: str = "passage") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))
