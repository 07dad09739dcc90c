import json
import struct
import tomllib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import text
from nearfield.functions.text import machine_id
from nearfield.operators import analytics, costs, ivf, schemes, sweep
from nearfield.operators.knn import exact_knn
from nearfield.sources import index_cache, run_tree, text_files, vec_files
from tests.test_vectors import frame


def test_fvecs_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((57, 5)).astype(np.float32)
    path = str(tmp_path / "a.fvecs")
    assert vec_files.write_fvecs(frame(spark, x), path) == 57
    got = vec_files.read_fvecs(spark, path).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(57))
    np.testing.assert_array_equal(np.array([r["embedding"] for r in got], np.float32), x)


def test_ivecs_round_trip_and_truncation(spark, tmp_path):
    path = str(tmp_path / "a.ivecs")
    vec_files.write_ivecs(spark.createDataFrame([(0, [3, 1]), (1, [2, 7])], "qid long, ids array<int>"), path)
    assert [r["ids"] for r in vec_files.read_ivecs(spark, path).orderBy("qid").collect()] == [[3, 1], [2, 7]]
    (tmp_path / "cut.fvecs").write_bytes(struct.pack("<i2f", 2, 1, 2)[:-1])
    with pytest.raises(ValueError):
        vec_files.read_fvecs(spark, str(tmp_path / "cut.fvecs"))
    (tmp_path / "empty.fvecs").write_bytes(b"")
    assert vec_files.read_fvecs(spark, str(tmp_path / "empty.fvecs")).count() == 0


def test_passages_and_queries(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tone\ttab\nbad line\n2\ttwo\n")
    p = text_files.read_passages_tsv(spark, str(tmp_path / "c.tsv"))
    assert sorted(map(tuple, p.collect())) == [("1", "one\ttab"), ("2", "two")]
    text_files.write_passages_jsonl(p, str(tmp_path / "j"))
    assert sorted(map(tuple, text_files.read_passages_jsonl(spark, str(tmp_path / "j")).collect())) == [("1", "one\ttab"), ("2", "two")]
    (tmp_path / "queries.dev.tsv").write_text("7\twhat\n")
    assert text_files.read_queries_tsv(spark, str(tmp_path)).first() == ("7", "what")
    with pytest.raises(FileNotFoundError):
        text_files.read_queries_tsv(spark, str(tmp_path / "none"))


TOML = """status = "complete"
git-sha = "abc"
target-features = ["avx2", "avx512f"]
[ivf]
n-centroids = 317
[index]
cache-hit = false
build-duration-secs = 1.5
[scheme-config]
scheme = "plaintext"
nprobe-values = [1, 2, 4]
[dataset]
n-passages = 100
"""


def test_run_tree(spark, tmp_path):
    header = ",".join(x.split()[0] for x in run_tree.RAW_SCHEMA.replace("\n", " ").split(", "))
    for run, rows in (("17", "17,plaintext,nprobe,4.0,nprobe=4,10,0,0.900000,,3072,80,40,0,0,0,0,m1,cpu,0,8,800,100\n"), ("18", "")):
        d = tmp_path / "m1" / "sha1" / run
        d.mkdir(parents=True)
        (d / "raw.csv").write_text(header + "\n" + rows)
        (d / "run-metadata.toml").write_text(TOML if run == "17" else "status = ")
    raw = run_tree.read_raw(spark, str(tmp_path))
    meta = run_tree.read_metadata(spark, str(tmp_path))
    r = run_tree.with_metadata(raw, meta, "status", "n_centroids").first()
    assert (r["path_run"], r["latency_us"], r["recall_at_k"], r["status"], r["n_centroids"]) == ("17", None, 0.9, "complete", 317)
    m = {x["path_run"]: x for x in meta.collect()}
    assert m["17"]["sweep_size"] == 3 and m["17"]["device"] == "cpu" and m["17"]["build_secs"] == 1.5 and m["17"]["verification_enabled"] is False
    assert m["18"]["status"] == "unreadable"
    run_tree.write_raw(raw.drop("path_machine", "path_sha", "path_run"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "0.900000,,3072" in text


def test_legacy_measurements_are_filled(spark, tmp_path):
    (tmp_path / "old.csv").write_text("run-id,scheme,latency-us,pre-query-offline-bytes\n5,sap,1500,9\n")
    r = run_tree.read_legacy_raw(spark, str(tmp_path / "old.csv")).first()
    assert (r["device"], r["batch_size"], r["wallclock_us"], r["latency_ms"], r["pre_query_offline_up_bytes"], r["effective_bytes_per_query"]) == ("cpu", 1, 1500, 1.5, 9, 0)


def test_registry_appends_only_new_keys(spark, tmp_path):
    a = spark.createDataFrame([("m1", 1), ("m2", 2)], "machine_id string, n int")
    path = str(tmp_path / "machines")
    assert [run_tree.append_missing(a, path, ["machine_id"]), run_tree.append_missing(a, path, ["machine_id"])] == [2, 0]
    assert spark.read.parquet(path).count() == 2


def test_ids_go_on_over_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vec_files, "CHUNK", 7)
    x = np.random.default_rng(0).standard_normal((501, 3)).astype(np.float32)
    path = str(tmp_path / "a.fvecs")
    vec_files.write_fvecs(frame(spark, x), path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    key = "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(key, "1000")
    try:
        assert spark.sparkContext.binaryRecords(path, 16).getNumPartitions() > 4
        got = {r["vec_id"]: r["embedding"] for r in vec_files.read_fvecs(spark, path).collect()}
    finally:
        conf.unset(key)
    assert sorted(got) == list(range(501))
    np.testing.assert_array_equal(np.array([got[i] for i in range(501)], np.float32), x)


def test_figure_files_have_fixed_digits(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "scheme string, x double")
    run_tree.write_tsv(df, str(tmp_path / "t"), {"x": 4})
    lines = next((tmp_path / "t").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "scheme\tx" and sorted(lines[1:]) == ["a\t0.5000", "b\tnan"]


def test_index_cache_hits_only_for_the_same_vectors(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((30, 4)).astype(np.float32)
    first, again = (index_cache.build_or_read(frame(spark, x), str(tmp_path), k=3, max_iter=2) for _ in range(2))
    x[0, 0] += 1
    other = index_cache.build_or_read(frame(spark, x), str(tmp_path), k=3, max_iter=2)
    assert [first.cache_hit, again.cache_hit, other.cache_hit] == [False, True, False]


def test_sweep_measures_recall_and_batches(spark):
    x = np.random.default_rng(0).standard_normal((60, 4)).astype(np.float32)
    index = ivf.build(frame(spark, x), k=4, max_iter=2)
    q = frame(spark, x[:5], "qid")
    truth = exact_knn(frame(spark, x), q, 5)
    raw, top_k = sweep.sweep(sweep.nprobe_settings(index, (1, 4)), q, truth, 5, batch_sizes=(2,), most=5)
    rows = raw.collect()
    assert len(rows) == 8 and all(r["latency_us"] is None and r["amortised_latency_us"] == r["wallclock_us"] // 2 for r in rows)
    assert {r["recall_at_k"] for r in rows if r["quality_param"] == 4} == {1.0}
    assert raw.columns == [x.split()[0] for x in run_tree.RAW_SCHEMA.replace("\n", " ").split(",")]
    assert top_k.where("rank = 0").count() == 8 and top_k.columns == [x.split()[0] for x in run_tree.TOP_K_SCHEMA.split(", ")]
    bits = sweep.bits_sweep(frame(spark, x), q, 5, (20,)).agg({"recall": "min"}).first()[0]
    assert bits == 1.0


def test_sweep_states_costs_verification_and_steps(spark):
    x = np.random.default_rng(0).standard_normal((60, 4)).astype(np.float32)
    index = ivf.build(frame(spark, x), k=4, max_iter=2)
    q = frame(spark, x[:2], "qid")
    truth = exact_knn(frame(spark, x), q, 5, "ip")
    blind = schemes.Blinded(n=8, shrink=1)
    (setting,) = sweep.nprobe_settings(index, (2,), blind, verify=True)
    raw, _ = sweep.sweep([setting], q, truth, 5)
    size = {r["cid"]: r["count"] for r in index.postings.groupBy("cid").count().collect()}
    routes = {}
    for r in ivf.route(q, index.centroids, 2).collect():
        routes.setdefault(r["qid"], []).append(size[r["cid"]])
    for r in raw.collect():
        own = routes[r["query_id"]]
        assert r["scheme"] == "bntm-ivf" and r["response_bytes"] == 8 * sum(own) and r["effective_bytes_per_query"] == 8 * costs.BN_WIDTH * sum(own)
        assert r["verification_overhead_us"] > 0 and r["latency_us"] == r["wallclock_us"] > 0 and r["setup_bytes"] == 60 * 8 * costs.BN_WIDTH
    steps = {(r["query_id"], r["substep"]): r["us"] for r in sweep.breakdown(setting, q, 5).collect()}
    assert set(steps) == {(i, s) for i in (0, 1) for s in sweep.SUBSTEPS}
    assert all((us == 0) == (s == "decompress") for (_, s), us in steps.items())
    plain = {r["substep"]: r["us"] for r in sweep.breakdown(sweep.nprobe_settings(index, (1,))[0], q.where("qid = 0"), 5).collect()}
    assert plain["server-compute"] > 0 and plain["verify"] == plain["decompress"] == plain["decode"] == 0


def test_written_runs_are_read_again(spark, tmp_path):
    root = tmp_path / "runs" / "m1" / "sha1" / "17"
    hits = spark.createDataFrame([("nprobe=1", 0, 0, 7, 0.5)], "config_label string, query_id long, rank int, doc_id long, score double")
    run_tree.write_top_k(hits.coalesce(1), str(root / "a"))
    for part in (root / "a").glob("*.csv"):
        part.rename(root / "top_k.csv")
    steps = spark.createDataFrame([("17", "emvp", "nprobe", 1.0, "nprobe=1", 0, "route", 12, "m1")], run_tree.SUBSTEP_SCHEMA)
    run_tree.write_substeps(steps.coalesce(1), str(root / "b"))
    for part in (root / "b").glob("*.csv"):
        part.rename(root / "substep-breakdown.csv")
    got = run_tree.read_top_k(spark, str(tmp_path / "runs")).first()
    assert (got["doc_id"], got["path_machine"], got["path_run"]) == (7, "m1", "17")
    got = run_tree.read_substeps(spark, str(tmp_path / "runs")).first()
    assert (got["substep"], got["us"], got["path_sha"]) == ("route", 12, "sha1")
    (root / "index.csv").write_text("run_id,machine_id,git_sha,git_dirty,scheme,dataset,started_at,duration_secs,status,path\n17,m1,sha1,false,emvp,x,2024-01-02T03:04:05Z,9,complete,p\n")
    row = run_tree.read_index(spark, str(root / "index.csv")).first()
    assert (row["run_id"], row["git_dirty"], row["duration_secs"], row["status"]) == ("17", False, 9, "complete")


def test_only_the_folders_of_picked_runs_are_read(spark, tmp_path):
    for run in ("1", "2", "3"):
        d = tmp_path / "m" / "s" / run
        d.mkdir(parents=True)
        header = [x.split()[0] for x in run_tree.RAW_SCHEMA.replace("\n", " ").split(",")]
        (d / "raw.csv").write_text(f"{','.join(header)}\n{run}{',' * (len(header) - 1)}\n")
    runs = spark.createDataFrame([("m", "s", "1"), ("m", "s", "3")], "path_machine string, path_sha string, path_run string")
    rows = run_tree.read_raw(spark, str(tmp_path), runs=runs)
    assert sorted((r["run_id"], r["path_run"]) for r in rows.collect()) == [("1", "1"), ("3", "3")]
    assert len(rows.inputFiles()) == 2 and run_tree.read_raw(spark, str(tmp_path)).count() == 3
    assert run_tree.read_raw(spark, str(tmp_path), runs=runs.limit(0)).count() == 0


def test_metadata_documents_are_replaced_whole(spark, tmp_path):
    root = tmp_path / "m1" / "sha1" / "18"
    root.mkdir(parents=True)
    path = str(root / "run-metadata.toml")
    doc = {"status": "running", "git-sha": 'a"b', "target-features": ["avx2"], "none": None, "ivf": {"n-centroids": 3}, "index": {"cache-hit": True, "build-duration-secs": 0.5, "deep": {"x": [1, 2]}}}
    run_tree.write_metadata(spark, path, doc)
    assert tomllib.loads((root / "run-metadata.toml").read_text()) == {k: v for k, v in doc.items() if k != "none"}
    run_tree.write_metadata(spark, path, doc | {"status": "complete"})
    row = run_tree.read_metadata(spark, str(tmp_path)).first()
    assert (row["status"], row["n_centroids"], row["cache_hit"], row["git_sha"]) == ("complete", 3, True, 'a"b')
    assert [p.name for p in root.iterdir() if "tmp" in p.name and not p.name.startswith(".")] == []


def test_small_expressions(spark):
    df = spark.createDataFrame([("a&b ~ x^2 \\ {c} #1 $5 10% _",), ("plain",), (None,)], "s string")
    got = [r[0] for r in df.select(text.tex_escape(F.col("s"))).collect()]
    assert got == [r"a\&b \textasciitilde{} x\textasciicircum{}2 \textbackslash{} \{c\} \#1 \$5 10\% \_", "plain", None]
    h = 0xCBF29CE484222325
    for b in (2).to_bytes(8, "little") + b"ab" + (0).to_bytes(8, "little"):
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    assert text.fnv1a64([b"ab", b""]) == h
    analytics.require_one(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int"), "a", "b")
    with pytest.raises(ValueError):
        analytics.require_one(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), "a", "b")


def test_machine_ids_are_stable():
    assert machine_id("x", 8, 1) == machine_id("x", 8, 1) != machine_id("x", 9, 1) and len(machine_id("x", 8, 1)) == 8
    assert json.dumps(machine_id("x", 8, 1))


def test_stream_of_queries(spark, tmp_path):
    from nearfield.streaming.search import search_stream

    x = np.random.default_rng(0).standard_normal((40, 4)).astype(np.float32)
    index = ivf.build(frame(spark, x), k=3, max_iter=2)
    frame(spark, x[:3], "qid").write.parquet(str(tmp_path / "in"))
    seen = []
    q = search_stream(spark.readStream.schema("qid long, embedding array<float>").parquet(str(tmp_path / "in")), index, 2, 3, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert len(seen) == 6 and {r["vec_id"] for r in seen if r["rank"] == 1} == {0, 1, 2}


def test_interop_files_and_digests(spark, tmp_path):
    import hashlib

    from nearfield.operators.analytics import manifest_state

    (tmp_path / "timing.csv").write_text("query_id,encode_us,upload_us,server_us,download_us,decode_us,total_us\n0,1,2,3,4,5,15\n")
    (tmp_path / "out.csv").write_text("query_id,rank,doc_id,score\n0,0,7,0.5\n")
    t, o = run_tree.read_interop(spark, str(tmp_path / "timing.csv"), str(tmp_path / "out.csv"))
    assert t.first()["total_us"] == 15 and o.first()["doc_id"] == 7
    run_tree.write_interop(frame(spark, [[1, 2], [3, 4]]), str(tmp_path / "emb"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "emb").glob("part*")))
    assert lines == "1.0,2.0\n3.0,4.0\n"
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.bin").write_bytes(b"abc")
    own = run_tree.file_digests(spark, str(tmp_path / "files"))
    assert own.first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    stated = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest(), 3), ("b.bin", "x", 1)], "name string, sha256 string, bytes long")
    assert {r["name"]: r["state"] for r in manifest_state(stated, own).collect()} == {"a.bin": "same", "b.bin": "absent"}
