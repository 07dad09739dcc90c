from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from nearfield import bitmap, session
from nearfield.sampling import smallest_hashes


def test_scratch_folder_is_the_sessions_own():
    own = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named or d), sparkContext=SimpleNamespace(master=master))
    assert session.scratch_dir(own("spark://x", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.scratch_dir(own("local[4]")) == session.scratch_dir(own("local")) == session.LOCAL_SCRATCH
    for master in ("yarn", "spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.scratch_dir(own(master))


def test_columns_of_any_names(spark):
    from nearfield.tables import fresh, lookup

    df = spark.createDataFrame([(i % 3, i, i, i) for i in range(30)], "k long, _may long, _word long, _bits long")
    gone = spark.createDataFrame([(1,)], "k long")
    assert sorted(bitmap.anti_join(df, gone, "k").collect()) == sorted(r for r in df.collect() if r["k"] != 1)
    assert fresh(df, "_MAY", "x", "x") == ["_MAY_", "x", "x_"]
    salted = df.withColumnRenamed("_bits", "_salt").unionByName(spark.createDataFrame([(None, 1, 1, 1)], "k long, _may long, _word long, _salt long"))
    names = spark.createDataFrame([(0, "a"), (2, "c")], "k long, name string")
    want = [(*r, {0: "a", 2: "c"}.get(r["k"])) for r in salted.collect()]
    plain = lambda rows: sorted((tuple(r[c] for c in (*salted.columns, "name")) for r in rows), key=str)
    assert plain(lookup(salted, "k", names, "_may", "left").collect()) == sorted(want, key=str)
    assert plain(lookup(salted, "k", names, "_may").collect()) == sorted((w for w in want if w[-1]), key=str)


def test_tables_are_written_and_discarded(spark):
    t = session.materialise(spark.range(5), "test")
    assert t.count() == 5
    session.discard(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._nearfield_path)


def test_batch_setting_is_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), session.arrow_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        1 / 0
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 26])
def test_anti_join_is_exact_with_any_bitmap(spark, bits, monkeypatch):
    monkeypatch.setattr(bitmap, "BITS", bits)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("_may_be"), F.lit(None).cast("int").alias("n")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'y' AS _may_be, 1 AS n"))
    gone = spark.range(0, 400, 3).select(F.col("id").alias("doc_id"))
    got = bitmap.anti_join(df, gone, "doc_id")
    assert got.columns == df.columns
    assert sorted(r[0] for r in got.where("doc_id IS NOT NULL").collect()) == [i for i in range(400) if i % 3]
    assert got.where("doc_id IS NULL").count() == 1
    assert bitmap.anti_join(df, gone.limit(0), "doc_id").count() == 401


def test_samples_are_exact_and_independent_of_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"] for r in smallest_hashes(df, ["k"], 100).collect()}
    assert len(a) == 100 and a == {r["k"] for r in smallest_hashes(df.repartition(7), ["k"], 100, 5000).collect()}
    assert smallest_hashes(df.limit(3), ["k"], 100).count() == 3


def test_times_do_not_depend_on_the_session(spark):
    from nearfield.functions import text

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(text.iso_utc(F.lit(1781083455)).alias("iso")).select("iso", text.local_display(F.col("iso"), "Asia/Tokyo").alias("tokyo")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == ("2026-06-10T09:24:15Z", "2026-06-10 18:24")
