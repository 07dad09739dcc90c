"""Binary vector files: records of a little-endian dimension and that many components.

Files are read by Spark's fixed-length record input, so they are split, may be of any size, and may lie in any store that Spark reaches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearfield.session import ship

#: Records that pass from Spark's reader as one value.
CHUNK = 1024


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dimension(spark: SparkSession, path: str) -> int:
    """The dimension of the first record; 0 for an empty file. A file that ends within a record is refused."""
    p, fs = _file(spark, path)
    size = fs.getFileStatus(p).getLen()
    if size == 0:
        return 0
    if size < 4:
        raise ValueError(f"{path} ends within a record")
    stream = fs.open(p)
    try:
        dim = struct.unpack("<i", struct.pack(">i", stream.readInt()))[0]
    finally:
        stream.close()
    if dim <= 0 or size % (4 + 4 * dim):
        raise ValueError(f"{path} ends within a record or holds vectors of different dimension")
    return dim


def _read(spark: SparkSession, path: str, kind: str, name: str, id_col: str) -> DataFrame:
    ship(spark)
    dim = dimension(spark, path)
    schema = f"{id_col} long, {name} array<{'float' if kind == '<f4' else 'int'}>"
    if dim == 0:
        return spark.createDataFrame([], schema)
    records = spark.sparkContext.binaryRecords(path, 4 + 4 * dim)
    # All splits of a file but its last have as many records as the first, so a split's place says where its ids start.
    (each,) = spark.sparkContext.runJob(records, lambda it: [sum(1 for _ in it)], [0])

    def chunks(split: int, it: Iterator[bytes]) -> Iterator[tuple[int, bytearray]]:
        at = split * each
        while chunk := list(islice(it, CHUNK)):
            yield at, bytearray(b"".join(chunk))
            at += len(chunk)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
                if (raw[:, 0] != dim).any():
                    raise ValueError(f"{path} holds vectors of different dimension")
                flat = pa.array(np.ascontiguousarray(raw[:, 1:]).view(kind).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * dim, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(raw))), lists], [id_col, name])

    return spark.createDataFrame(records.mapPartitionsWithIndex(chunks), "at long, raw binary").mapInArrow(decode, schema)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding): the i-th record has id i."""
    return _read(spark, path, "<f4", "embedding", "vec_id")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ids)."""
    return _read(spark, path, "<i4", "ids", "qid")


def _write(df: DataFrame, path: str, id_col: str, name: str, kind: str) -> int:
    """One file in the order of the ids; rows pass through the driver a partition at a time."""
    p, fs = _file(df.sparkSession, path)
    out = fs.create(p, True)
    n = 0
    try:
        for row in df.select(id_col, name).orderBy(id_col).toLocalIterator(prefetchPartitions=True):
            v = np.asarray(row[1], kind)
            out.write(bytearray(struct.pack("<i", len(v)) + v.tobytes()))
            n += 1
    finally:
        out.close()
    return n


def write_fvecs(df: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    return _write(df, path, id_col, vector_col, "<f4")


def write_ivecs(df: DataFrame, path: str, id_col: str = "qid", ids_col: str = "ids") -> int:
    return _write(df, path, id_col, ids_col, "<i4")
