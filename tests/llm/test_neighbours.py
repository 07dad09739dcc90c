import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import neighbours


def vectors(spark, x, ids=None):
    rows = [(int(i), None if v is None else [None if e is None else float(e) for e in v], 0, 1.0) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def brute(x, ids, k, asks):
    out = {}
    for i in asks:
        s = [(-float((x[i].astype(float) * x[j].astype(float)).sum()), ids[j]) for j in range(len(x)) if ids[j] != ids[i]]
        out[ids[i]] = [(v, -p) for p, v in sorted(s)[:k]]
    return out


def run(df, k=20):
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_exact_scores(spark, scale, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 700)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    g = np.random.default_rng(0)
    x = g.standard_normal((2000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * (g.random((2000, 1)) + 0.5 if scale else 1)).astype(np.float32)
    got, want = run(vectors(spark, x)), brute(x, list(range(2000)), 20, range(0, 2000, 20))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
    for q, rows in got.items():
        assert len(rows) == 20 and q not in {v for v, _ in rows}
        for v, s in rows:
            assert s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-12)


def test_equal_vectors_rank_by_id(spark):
    g = np.random.default_rng(1)
    x = np.vstack([np.ones((300, 8)), g.standard_normal((50, 8))]).astype(np.float32)
    got = run(vectors(spark, x))
    assert [v for v, _ in got[20]] == [i for i in range(21) if i != 20]


def test_few_candidates_and_bad_vectors(spark):
    x = [[1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [], [1, 1], [1, 2, 3]]
    got = run(vectors(spark, x, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]))
    assert got == {0: [(8, 1.0), (1, 0.0)]}
    assert run(vectors(spark, [])) == {}
    assert run(vectors(spark, [None, [0.0]])) == {}
    null_id = spark.createDataFrame([(None, [1.0]), (0, [1.0])], "vec_id long, embedding array<float>")
    assert run(null_id) == {}


def test_repeated_rows(spark):
    got = run(vectors(spark, [[1, 0], [1, 0], [0, 1], [0, 1]], [0, 0, 5, 5]))
    assert got == {0: [(5, 0.0), (5, 0.0)]}


def test_descent_and_ascent():
    x = neighbours._unit(np.eye(40)[:, :40], 1.0)
    f = neighbours.Forest(x)
    low, high = f.ascend(x[:5], 10**9)
    assert (low == 0).all() and (high == 40).all()
    low, high = f.ascend(x[:5], 1)
    for i in range(5):
        assert i in f.candidates(low[:, i], high[:, i])
    assert ((high - low).sum(0) >= 1).all() and math.isfinite(neighbours.choose_share(np.eye(40), 3, 1.0))


def test_hyperplanes_of_a_tree_are_orthogonal():
    for dim in (3, 24, 65):
        p = neighbours._hyperplanes(dim)
        assert p.shape == (neighbours.TREES, dim, neighbours.BITS)
        own = p[5][:, : min(dim, neighbours.BITS)]
        assert np.allclose(own.T @ own, np.eye(own.shape[1]), atol=1e-5)


def test_only_candidates_are_found(monkeypatch):
    """Near vectors in groups: few candidates suffice, and all that is found is among them."""
    g = np.random.default_rng(3)
    centres = g.standard_normal((100, 32))
    x = np.repeat(centres, 40, 0) + 0.05 * g.standard_normal((4000, 32))
    largest = float(np.linalg.norm(x, axis=1).max())
    share, named, recall = next(c for c in neighbours.share_curve(x, 20, largest) if c[2] >= neighbours.TARGET)
    assert named < 0.1
    seen = []
    own = neighbours.Forest.candidates
    monkeypatch.setattr(neighbours.Forest, "candidates", lambda self, a, b: seen.append(own(self, a, b)) or seen[-1])
    ids = np.arange(len(x))
    hits = 0
    for q, found, score in neighbours.search(ids, x, ids[:50], x[:50], 20, share, largest):
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(found) & set(np.argsort(-exact)[:20]))
    assert len(seen) == 50 and np.mean([len(c) for c in seen]) < 0.1 * len(x) and hits >= 0.9 * 50 * 20
