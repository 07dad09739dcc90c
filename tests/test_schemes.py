import json
from dataclasses import replace

import numpy as np
import pytest

from nearfield.operators import costs, ivf, knn, schemes
from nearfield.session import read_document, write_document
from nearfield.sources import index_cache
from tests.test_vectors import by_query, frame


@pytest.fixture(scope="module")
def unit():
    x = np.random.default_rng(2).standard_normal((40, 16))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def exact_products(x, q):
    r = lambda z: np.copysign(np.floor(np.abs(z.astype(float) * (1 << 20)) + 0.5), z).astype(np.int64)
    return r(x) @ r(q).T


@pytest.mark.parametrize("scheme", [schemes.Trapdoor(ell0=16, n=27, b=9), schemes.Blinded(n=32, shrink=2), schemes.Blinded(n=16, shrink=1)])
def test_products_come_back_exactly(spark, unit, scheme):
    got = {(r["qid"], r["vec_id"]): r["value"] for r in schemes.top(scheme, frame(spark, unit), frame(spark, unit[:3], "qid"), 100).collect()}
    want = exact_products(unit, unit[:3])
    assert got == {(j, i): int(want[i, j]) for i in range(len(unit)) for j in range(3)}
    best = [(r["qid"], r["rank"], r["vec_id"]) for r in schemes.top(scheme, frame(spark, unit).repartition(3), frame(spark, unit[:3], "qid"), 4).orderBy("qid", "rank").collect()]
    assert best == [(j, n + 1, int(i)) for j in range(3) for n, i in enumerate(np.lexsort((np.arange(len(unit)), -want[:, j]))[:4])]


def test_production_widths_once():
    t = schemes.Trapdoor()
    assert t.blocks == 76
    x, q = np.eye(2, 64, dtype=np.float32), np.eye(1, 64, dtype=np.float32)
    d = t.expansion()
    ids = np.arange(2)
    e = t.encode(q, d)
    assert t.decode(ids, t.products(t.encrypt(ids, x, d), e), e).ravel().tolist() == [1 << 40, 0]


def test_wrong_shapes_are_refused():
    with pytest.raises(ValueError):
        schemes.Trapdoor(ell0=16, n=28, b=9)
    with pytest.raises(ValueError):
        schemes.Trapdoor(ell0=4, n=9, b=9)._padded(np.zeros((1, 5)))
    with pytest.raises(ValueError):
        schemes.scale_keygen(0, 1)


def test_noise_free_ranking_is_plain(spark, unit):
    key = schemes.scale_keygen()
    enc = lambda x, c: schemes.scale_encrypt(frame(spark, x, c), key, id_col=c).withColumnRenamed("cipher", "embedding")
    assert by_query(knn.exact_knn(enc(unit, "vec_id"), enc(unit[:5], "qid"), 8)) == by_query(knn.exact_knn(frame(spark, unit), frame(spark, unit[:5], "qid"), 8))


def test_noise_depends_on_the_row_alone(spark, unit):
    key = schemes.scale_keygen()
    a, b = ({r["vec_id"]: r["cipher"] for r in schemes.scale_encrypt(frame(spark, unit).repartition(n), key, 0.5).collect()} for n in (1, 4))
    assert a == b
    far = [np.linalg.norm(np.array(a[i]) - key.scale * unit[i].astype(float)) for i in a]
    assert 0 < max(far) <= key.scale * 0.5 / 4 + 1e-9
    assert "0." not in repr(key)
    with pytest.raises(ValueError):
        schemes.scale_encrypt(frame(spark, unit), key, -1)


def test_tampering_is_noticed(spark, unit):
    b = schemes.Blinded(n=16, shrink=1)
    x, q = frame(spark, unit), frame(spark, unit[:2], "qid")
    schemes.require_verified(b.verify(x, q))
    with pytest.raises(ValueError):
        schemes.require_verified(b.verify(x, q, tamper=1))


def test_retrieval_recovers_code_products(spark, unit):
    r = schemes.Retrieval(bits=4, p=1 << 15, n=128)
    postings = frame(spark, unit).selectExpr("*", "0L AS cid")
    routes = spark.createDataFrame([(0, 0), (1, 0)], "qid long, cid long")
    found = ivf.probe(r.encoded(postings), routes, frame(spark, unit[:2], "qid"), 100, r)
    got = {(x["qid"], x["vec_id"]): x["value"] for x in found.collect()}
    lift = lambda c: np.where(c.astype(np.int64) > r.p // 2, c.astype(np.int64) - r.p, c.astype(np.int64))
    want = lift(r.codes(unit)) @ lift(r.codes(unit[:2])).T
    assert got == {(j, i): int(want[i, j]) for i in range(len(unit)) for j in range(2)}


SCHEMES = [schemes.Trapdoor(ell0=16, n=27, b=9), schemes.Blinded(n=16, shrink=1), schemes.Retrieval(n=64)]


@pytest.fixture(scope="module")
def index(spark, unit):
    return ivf.build(frame(spark, unit), k=4, max_iter=3)


@pytest.mark.parametrize("scheme", SCHEMES)
def test_routed_search_ranks_exact_products_of_routed_clusters(spark, unit, index, scheme, monkeypatch):
    cid = {r["vec_id"]: r["cid"] for r in index.postings.collect()}
    q = frame(spark, unit[:6], "qid")
    routes = {}
    for r in ivf.route(q, index.centroids, 2).collect():
        routes.setdefault(r["qid"], set()).add(r["cid"])
    if scheme.name == "tiptoe":
        lift = lambda c: np.where(c.astype(np.int64) > scheme.p // 2, c.astype(np.int64) - scheme.p, c.astype(np.int64))
        want = lift(scheme.codes(unit)) @ lift(scheme.codes(unit[:6])).T
    else:
        want = exact_products(unit, unit[:6])
    brute = {j: sorted((-int(want[i, j]), i) for i in range(len(unit)) if cid[i] in routes[j])[:5] for j in range(6)}
    encoded = index.encoded(scheme)

    def run(df):
        got = {}
        for r in df.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((-r["value"], r["vec_id"]))
        return got

    assert run(encoded.search(q, 5, 2, scheme)) == brute
    assert run(ivf.probe(encoded.postings, ivf.route(q, index.centroids, 2), q, 5, scheme)) == brute
    monkeypatch.setattr(knn, "BLOCK_BYTES", 2 * max(scheme.query_bytes, 16 * 8) + 64)  # some queries a block
    assert run(encoded.search(q, 5, 2, scheme)) == brute
    assert run(ivf.probe(encoded.postings, ivf.route(q, index.centroids, 2), q, 5, scheme)) == brute
    monkeypatch.setattr(ivf, "CENTROID_BYTES", 8)  # centroids in blocks
    assert run(ivf.Index(index.centroids, encoded.postings).search(q, 5, 2, scheme)) == brute


@pytest.mark.parametrize("scheme", SCHEMES)
def test_encoded_indexes_survive_a_round_trip_and_refuse_others(spark, unit, index, scheme, tmp_path):
    q = frame(spark, unit[:3], "qid")
    want = index.encoded(scheme).search(q, 5, 2, scheme).collect()
    first, hit = index_cache.build_or_read_encoded(scheme, index, str(tmp_path))
    again, hit_again = index_cache.build_or_read_encoded(scheme, index, str(tmp_path))
    assert not hit and hit_again
    assert sorted(first.search(q, 5, 2, scheme).collect()) == sorted(again.search(q, 5, 2, scheme).collect()) == sorted(want)
    path = next(str(p) for p in tmp_path.iterdir())
    with pytest.raises(ValueError, match="params"):
        index_cache.read_encoded(spark, replace(scheme, seed=7), path)
    with pytest.raises(ValueError, match="scheme"):
        index_cache.read_encoded(spark, schemes.Blinded(n=16) if scheme.name == "emvp" else SCHEMES[0], path)
    own = index_cache.VERSION
    index_cache.VERSION = own + 1
    try:
        with pytest.raises(ValueError, match="version"):
            index_cache.read_encoded(spark, scheme, path)
    finally:
        index_cache.VERSION = own
    meta = json.loads(read_document(spark, f"{path}/meta.json"))
    write_document(spark, f"{path}/meta.json", json.dumps(meta | {"vectors": 41}))
    with pytest.raises(ValueError, match="41"):
        index_cache.read_encoded(spark, scheme, path)
    with pytest.raises(ValueError):
        index_cache.read_encoded(spark, scheme, f"{path}/none")


def test_routed_verification_finds_the_cluster(spark, unit, index):
    b = schemes.Blinded(n=16, shrink=1)
    q = frame(spark, unit[:3], "qid")
    routes = ivf.route(q, index.centroids, 2)
    schemes.require_verified(b.verify(index.postings, q, routes=routes))
    zero = index.postings.where("vec_id = 0").first()["cid"]
    bad = {(r["qid"], r["cid"]) for r in b.verify(index.postings, q, tamper=1, routes=routes).where("NOT ok").collect()}
    assert bad == {(r["qid"], r["cid"]) for r in routes.where(f"cid = {zero}").collect()} and bad


def test_hints_by_limbs_are_exact():
    g = np.random.default_rng(4)
    hint, s = g.integers(0, 1 << 64, (9, 2048), dtype=np.uint64), g.integers(0, 3, (4, 2048)).astype(np.uint64)
    np.testing.assert_array_equal(schemes.hint_times_secrets(hint, s), hint @ s.T)
    parts = schemes.hint_limbs(hint)
    assert parts.max() < 16 and (sum(p << np.uint64(4 * i) for i, p in enumerate(parts)) == hint).all()
    with pytest.raises(ValueError):
        schemes.check_ring(4096)
    assert schemes.CIPHER_BITS < 8 * 5 and costs.CIPHERTEXT == 2 * schemes.RING * 5


def test_a_zero_padded_query_reaches_one_cluster():
    r = schemes.Retrieval(n=64)
    g = np.random.default_rng(5)
    blocks = [r.codes(g.uniform(-1, 1, (5, 8))) for _ in range(3)]
    q = r.codes(g.uniform(-1, 1, (1, 8)))[0]
    for c in range(3):
        np.testing.assert_array_equal(np.hstack(blocks) @ schemes.augmented_query(q, c, 3), blocks[c] @ q)


def test_noise_costs_recall_and_no_more(spark, unit):
    key, q = schemes.scale_keygen(), frame(spark, unit[:8], "qid")
    truth = knn.exact_knn(frame(spark, unit), q, 5)
    hidden = lambda beta: knn.exact_knn(*(schemes.scale_encrypt(frame(spark, unit if c == "vec_id" else unit[:8], c), key, beta, id_col=c).withColumnRenamed("cipher", "embedding") for c in ("vec_id", "qid")), 5)
    recall = {b: knn.recall(hidden(b), truth, 5).agg({"recall": "avg"}).first()[0] for b in (0.0, 0.5, 8.0)}
    assert recall[0.0] == 1 and recall[0.0] >= recall[0.5] >= recall[8.0] and recall[0.5] > 0.5 > recall[8.0]
