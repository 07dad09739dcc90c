from collections import Counter

import numpy as np

from nearfield.llm import mixing
from tests.llm.helpers import EDGES, documents, split_words


def brute_targets(sizes):
    """Water filling, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = np.array([mixing.WEIGHTS[i % 3] for i in range(len(names))], float)
    cap = np.array([2.0 * sizes[n] for n in names])
    total, free, out = 1.5 * sum(sizes.values()), np.ones(len(names), bool), np.zeros(len(names))
    while free.any():
        out[free] = (total - cap[~free].sum()) * w[free] / w[free].sum()
        over = free & (out > cap)
        if not over.any():
            break
        out[over], free[over] = cap[over], False
    return dict(zip(names, out))


def check(rows, df):
    got = df.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split_words(t))
    targets = brute_targets(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1e-6


def test_edges(spark):
    check(EDGES, mixing.mix(documents(spark, EDGES)))


def test_hot_source_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    g = np.random.default_rng(0)
    rows = [(i, "w " * int(g.integers(0, 30)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(700)]
    df = documents(spark, rows)
    check(rows, mixing.mix(df))
    key = ["doc_id", "taken"]
    assert sorted(mixing.mix(df).select(key).collect()) == sorted(mixing.mix(df.repartition(3)).select(key).collect())


def test_expected_copies_are_kept(spark):
    """Over many draws the mean number of copies is the target rate of the source."""
    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 5 > 0]) for i in range(200)]
    df = documents(spark, rows)
    copies = np.array([[r["copies"] for r in mixing.mix(df, seed=s).orderBy("doc_id").collect()] for s in range(8)])
    rate = [r["target"] / r["source_size"] for r in mixing.mix(df).orderBy("doc_id").collect()]
    assert abs(copies.mean() - np.mean(rate)) < 0.05
    assert len(set(copies[0].tolist())) > 1


def test_one_source_and_empty_table(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    check([(1, "a b c", "en", "z")], mixing.mix(documents(spark, [(1, "a b c", "en", "z")])))
    check([(1, None, "en", None)], mixing.mix(documents(spark, [(1, None, "en", None)])))


def test_taken_rows_repeat(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "abc"[i % 3]) for i in range(90)] + [(500, None, "en", "a")]
    df = documents(spark, rows)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in mixing.take(df).groupBy("doc_id").count().collect()}
    assert got == want and mixing.take(df).columns == df.columns


def test_rows_with_null_and_repeated_ids_are_taken_as_the_mix_says(spark):
    rows = [(None if i % 4 == 0 else i % 13, "w " * (i % 7) + f"x{i}", "en", (None, "a", "b")[i % 3]) for i in range(180)]
    rows += [(3, "same text", "en", "a")] * 9 + [(None, "", "en", "b"), (None, None, None, None)]
    df = documents(spark, rows)
    want, got = Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for r in mixing.take(df).collect():
        got[r["doc_id"], r["source"], len(split_words(r["text"]))] += 1
    assert got == +want and any(k[0] is None for k in got)
    assert sorted(map(str, mixing.take(df).collect())) == sorted(map(str, mixing.take(df.repartition(3)).collect()))


def test_targets_of_many_sources_equal_water_filling(spark):
    g = np.random.default_rng(8)
    for seed in range(3):
        sizes = {f"s{i}é{i % 7}": int(x) for i, x in enumerate(g.pareto(0.6, 300) * 20)} | {None: int(seed * 1000), "": 0, "Z": 10**6}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert set(got) == set(want)
        for k in want:
            assert abs(got[k] - want[k]) <= 1e-9 * (1 + want[k]), k
        assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
