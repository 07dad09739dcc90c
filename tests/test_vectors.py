import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as v
from nearfield.operators import ivf, kernels, knn


def frame(spark, x, id_col="vec_id"):
    return spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(x)], f"{id_col} long, embedding array<float>")


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(1).uniform(-1, 1, (120, 8)).astype(np.float32)


def brute(x, q, k):
    d = np.sqrt(((x.astype(float)[None] - q.astype(float)[:, None]) ** 2).sum(2))
    return [list(np.lexsort((np.arange(len(x)), row))[:k]) for row in d]


def by_query(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["vec_id"])
    return out


def test_exact_knn_equals_brute_force(spark, cube):
    got = by_query(knn.exact_knn(frame(spark, cube), frame(spark, cube[:9], "qid"), 10))
    assert [got[i] for i in range(9)] == brute(cube, cube[:9], 10)


def test_queries_in_blocks_give_the_same(spark, cube, monkeypatch):
    whole = by_query(knn.exact_knn(frame(spark, cube), frame(spark, cube[:9], "qid"), 5))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 128)
    assert by_query(knn.exact_knn(frame(spark, cube), frame(spark, cube[:9], "qid"), 5)) == whole


def test_k_beyond_the_corpus_is_capped(spark, cube):
    assert knn.exact_knn(frame(spark, cube[:3]), frame(spark, cube[:1], "qid"), 100).count() == 3
    with pytest.raises(ValueError):
        knn.exact_knn(frame(spark, cube), frame(spark, cube[:1], "qid"), 0)


def test_equal_vectors_rank_by_id(spark):
    x = np.ones((6, 4), np.float32)
    assert by_query(knn.exact_knn(frame(spark, x), frame(spark, x[:1], "qid"), 4))[0] == [0, 1, 2, 3]


def test_empty_query_set(spark, cube):
    assert knn.exact_knn(frame(spark, cube), frame(spark, cube[:0], "qid"), 3).count() == 0


def test_full_probe_is_exact(spark, cube):
    index = ivf.build(frame(spark, cube), k=8, max_iter=4)
    q = frame(spark, cube[:7], "qid")
    assert by_query(index.search(q, 10, 50)) == by_query(knn.exact_knn(frame(spark, cube), q, 10))


def test_training_finds_separated_clusters(spark):
    x = np.array([[b + 0.01 * i, 0.01 * i] for b in (0, 100, 200) for i in range(30)], np.float32)
    c = ivf.centroid_matrix(ivf.train(frame(spark, x), 3))[1]
    assert sorted(np.round(c[:, 0] / 100).tolist()) == [0, 1, 2]


def test_training_is_deterministic(spark, cube):
    a, b = (ivf.centroid_matrix(ivf.train(frame(spark, cube).repartition(n), 6, max_iter=5))[1] for n in (2, 5))
    np.testing.assert_allclose(a, b, atol=1e-12)


def test_training_refuses_more_centroids_than_vectors(spark, cube):
    with pytest.raises(ValueError):
        ivf.train(frame(spark, cube[:3]), 4)
    with pytest.raises(ValueError):
        ivf.train(frame(spark, cube[:0]), 1)


def test_index_survives_a_round_trip(spark, cube, tmp_path):
    index = ivf.build(frame(spark, cube), k=5, max_iter=3)
    ivf.write(index, str(tmp_path))
    q = frame(spark, cube[:5], "qid")
    assert by_query(ivf.read(spark, str(tmp_path)).search(q, 5, 2)) == by_query(index.search(q, 5, 2))


def test_default_number_of_centroids():
    assert [ivf.default_centroids(n) for n in (1, 100, 100_000, 8_800_000)] == [1, 10, 317, 2967]


def test_recall_counts_the_shorter_truth(spark):
    truth = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "qid long, rank int, vec_id long")
    hits = spark.createDataFrame([(0, 1, 6), (0, 2, 7), (0, 3, 8)], "qid long, rank int, vec_id long")
    assert knn.recall(hits, truth, 10).first()["recall"] == 0.5


def test_field_kernels_equal_big_integers():
    g = np.random.default_rng(3)
    a, b = kernels.uniform61(g, 500), kernels.uniform61(g, 500)
    a[:2], b[:2] = kernels.P61 - 1, kernels.P61 - 1
    assert [int(x) for x in kernels.mul61(a, b)] == [int(x) * int(y) % kernels.P61 for x, y in zip(a, b)]
    m, n = kernels.uniform61(g, (7, 30)), kernels.uniform61(g, (30, 5))
    want = [[sum(int(m[i, t]) * int(n[t, j]) for t in range(30)) % kernels.P61 for j in range(5)] for i in range(7)]
    assert kernels.matmul61(m, n).tolist() == want
    assert [int(x) for x in kernels.sub61(a, b)] == [(int(x) - int(y)) % kernels.P61 for x, y in zip(a, b)]


def test_nearest_prefers_the_first_of_equals():
    c = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert kernels.nearest(np.array([[0.9, 0.1], [0.0, 2.0]]), c).tolist() == [0, 2]


def test_quantised_column_values(spark):
    row = spark.createDataFrame([([0.5, -0.5, 1.5 / (1 << 20)],)], "e array<double>").select(
        F.transform("e", lambda x: v.fixed_point(x)).alias("q"), F.transform("e", lambda x: v.signed_lift(v.to_field(x))).alias("back"), F.transform("e", lambda x: v.clamp_quantise(x, 4, 1 << 15)).alias("c")
    ).first()
    assert row["q"] == [1 << 19, -(1 << 19), 2] == row["back"]
    assert row["c"] == [8, (1 << 15) - 8, 0]
    with pytest.raises(ValueError):
        v.clamp_quantise(F.lit(1.0), 15, 1 << 15)
