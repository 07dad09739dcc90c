"""Session factory, shared scratch tables, and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_SCRATCH = "file:///tmp/checkpoints"

#: Bytes of an Arrow batch to a Python worker.
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearfield")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("NEARFIELD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once per application, and bounds their batches by size.

    The zip lies in the shared folder, from where Spark hands it out. Rows with whole texts are wide: a batch of the
    default 64 MB exists several times, in the JVM and in its worker. A smaller size that the session names itself stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "67108864"):
        spark.conf.set(key, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    folder = f"{scratch_dir(spark)}/nearfield-code-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/nearfield_package.zip")
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        stream.write(bytearray(buffer.getvalue()))
    finally:
        stream.close()
    _scratch.append((spark, folder))
    spark.sparkContext.addPyFile(f"{folder}/nearfield_package.zip")
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Without a name, a folder of this machine serves if all runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def materialise(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back. arrow_rows: rows of an Arrow batch meanwhile.

    The lineage is cut there: after the loss of an executor Spark reads the table again instead of
    computing what came before. The table is removed when the driver ends, or by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/nearfield-{name}-{uuid.uuid4().hex}"
    with arrow_batches(spark, arrow_rows):
        df.write.parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._nearfield_path = path
    return out


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Rows of an Arrow batch for the actions within; the session's own setting holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Removes tables of :func:`materialise` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_nearfield_path", None)
        if path:
            _delete(t.sparkSession, path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    if (spark, path) not in _scratch:
        _scratch.append((spark, path))


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def read_document(spark: SparkSession, path: str) -> str:
    """A small text file of any store; one that is not there is a ValueError."""
    if not exists(spark, path):
        raise ValueError(f"{path} is not there")
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file beside its place and then renames it, so that readers see the old one or the new one whole."""
    fs, p = _file(spark, path)
    _, own = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(own)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(own, p):
        raise OSError(f"{path} cannot be written")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
                continue
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass
        if path.startswith("file:"):  # a folder of this machine, of a session that was stopped before
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
