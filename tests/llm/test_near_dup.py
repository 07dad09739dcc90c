import random
import re

import numpy as np
import pytest

from nearfield.llm import components as component_module
from nearfield.llm import near_dup, shingles
from nearfield.llm.components import components, smallest_labels
from tests.llm.helpers import EDGES, WHITE, documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(t, k):
    w = [x for x in re.split(WHITE, (t or "").translate(LOWER)) if x]
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


def brute(rows, k, percent=80):
    ids = sorted({d for d, *_ in rows if d is not None})
    up = {d: d for d in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    sets = [(d, shingle_set(t, k)) for d, t, *_ in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    out = []
    for d, s in sets:
        c = None if d is None else find(d)
        out.append((d, len(s), c, d == c))
    return sorted(out, key=str)


def run(df, k):
    return sorted(map(tuple, near_dup.near_components(df, k).collect()), key=str)


def variants(n, seed, edits, words=60):
    g = random.Random(seed)
    base = [f"w{g.randrange(500)}" for _ in range(words)]
    rows, cur = [], list(base)
    for i in range(n):
        t = list(base if i % 3 else cur)
        for _ in range(g.randrange(edits + 1)):
            t[g.randrange(len(t))] = f"e{g.randrange(10**6)}"
        cur = t
        rows.append((i, " ".join(t), "en", "s"))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_edges_equal_brute_force(spark, k):
    assert run(documents(spark, EDGES), k) == brute(EDGES, k)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies_equal_brute_force(spark, seed):
    rows = variants(150, seed, 3) + [(1000 + d, t, x, s) for d, t, x, s in variants(40, seed + 10, 8)]
    assert run(documents(spark, rows), 4) == brute(rows, 4)


def test_large_clusters_in_small_blocks_lose_no_link(spark, monkeypatch):
    """Stars, hubs and cross-block tasks, which usual sizes do not reach here."""
    for name, value in (("SMALL", 4), ("BLOCK", 12), ("HUBS", 2), ("WIDE", 10)):
        monkeypatch.setattr(near_dup, name, value)
    rows = variants(140, 5, 4)
    assert run(documents(spark, rows), 4) == brute(rows, 4)


def test_pairs_at_the_threshold(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(w[:21]), "en", "s"), (1, " ".join([*w[:18], "a", "b"]), "en", "s"), (2, "A b C d", "en", "s"), (3, "a B c D", "en", "s")]
    assert run(documents(spark, rows), 4) == brute(rows, 4)


def test_empty_table(spark):
    assert near_dup.near_components(documents(spark, [])).collect() == []


def test_hashes_agree_with_sets():
    texts = [t for _, t, *_ in EDGES] + ["The the THE Then", "b a b a b a b"]
    got = list(shingles.shingle_hashes(texts, 4))
    assert [len(g) for g in got] == [len(shingle_set(t, 4)) for t in texts]
    a, b = shingles.shingle_hashes(["one two three four five", "two three four five six"], 4)
    assert len(np.intersect1d(a, b)) == 1


def test_pruning_keeps_pairs_at_the_threshold():
    looks = near_dup.least_matches(0.8)
    g = np.random.default_rng(0)
    lost = np.zeros(20_000, bool)
    equal = g.random((20_000, near_dup.HASHES)) < 0.8
    for h, m in looks:
        lost |= equal[:, :h].sum(1) < m
    assert lost.mean() < 1e-3
    assert looks[-1][1] > 0.5 * near_dup.HASHES


@pytest.mark.parametrize("chunk,hot", [(250_000, 50_000), (9, 50_000), (20, 8)])
def test_components_of_paths_and_stars(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(component_module, "CHUNK", chunk)
    monkeypatch.setattr(component_module, "EDGES", hot)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_components_of_edges_that_change_from_run_to_run(spark):
    """Tasks may emit any spanning tree, and another one when they run again; both directions must be of one run."""
    from pyspark.sql import functions as F

    trees = F.expr("element_at(array(array(struct(x AS a, x + 1 AS b), struct(x + 1 AS a, x + 2 AS b)), array(struct(x AS a, x + 2 AS b), struct(x + 2 AS a, x + 1 AS b)), array(struct(x + 1 AS a, x AS b), struct(x AS a, x + 2 AS b))), CAST(floor(rand() * 3) AS INT) + 1)")
    edges = spark.range(300).select((F.col("id") * 3).alias("x")).select(F.explode(trees).alias("e")).select("e.a", "e.b")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: i // 3 * 3 for i in range(900)}


def test_very_long_texts_are_hashed_in_parts(monkeypatch):
    g = random.Random(2)
    texts = [" ".join(f"w{g.randrange(50)}" for _ in range(3000)), "y" * 9000 + " z", "\n".join("ab" for _ in range(2000)) + " ", "", None]
    whole = [x.tolist() for x in shingles.shingle_hashes(texts, 5)]
    monkeypatch.setattr(shingles, "PART_BYTES", 40)
    assert [x.tolist() for x in shingles.shingle_hashes(texts, 5)] == whole
    monkeypatch.undo()
    assert len(next(shingles.shingle_hashes(["one two three four five six " * 300_000], 5))) == 6


def templated(n, shared, own, seed):
    """Pages of one template, each with words of its own; every tenth repeats the one before but for a word."""
    g = random.Random(seed)
    head, rows = [f"t{i}" for i in range(shared)], []
    for i in range(n):
        words = head + [f"u{g.randrange(10**9)}" for _ in range(own)] if i % 10 or not rows else [*rows[-1][1].split()[:-1], "other"]
        rows.append((i, " ".join(words), "en", "s"))
    return rows


def test_templates_tie_clusters_but_not_pages(spark, monkeypatch):
    for name, value in (("SMALL", 8), ("BLOCK", 16), ("HUBS", 3)):
        monkeypatch.setattr(near_dup, name, value)
    rows = templated(220, 45, 30, 4) + [(1000 + d, t, x, s) for d, t, x, s in templated(60, 30, 40, 5)]
    met = []
    own = near_dup._by_block
    monkeypatch.setattr(near_dup, "_by_block", lambda df, run, schema, *also: met.append((also, df.count())) or own(df, run, schema, *also))
    assert run(documents(spark, rows), 5) == brute(rows, 5)
    # All rows that meet with full sets: little more than each document once, though the clusters have many blocks.
    assert sum(n for also, n in met if "members" in also) < 2 * len(rows)


def test_rows_that_stay(spark):
    """One row of each component, whatever the ids: repeated ones, null ones, and columns with names of the operator's own."""
    w = [f"w{i}" for i in range(30)]
    a, b, c = " ".join(w), " ".join([*w[:-1], "x"]), " ".join(reversed(w))
    rows = [(5, a, "en", "s"), (2, b, "en", "s"), (2, c, "en", "s"), (None, a + " ", "en", "s"), (None, "alone " * 9, "en", "s"), (7, None, "en", "s"), (7, "", "en", "s"), (2, "a unique text of its own here", "en", "s")]
    df = documents(spark, rows).withColumnRenamed("size", "_row").withColumnRenamed("norm", "row")
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(2, b), (2, c), (None, "alone " * 9), (7, None), (7, ""), (2, "a unique text of its own here")], key=str)
    assert near_dup.keep_one(documents(spark, [])).collect() == []


def test_smallest_labels_equal_a_search():
    g = np.random.default_rng(6)
    for n, m in ((30, 20), (200, 150), (200, 600), (1000, 900)):
        a, b = g.integers(0, n, m) * 7 - 50, g.integers(0, n, m) * 7 - 50
        near = {}
        for x, y in zip(a.tolist(), b.tolist()):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        want = {}
        for x in sorted(near):
            stack = [x]
            while stack:
                y = stack.pop()
                if y not in want:
                    want[y] = x
                    stack += near[y]
        nodes, labels = smallest_labels(a, b)
        assert dict(zip(nodes.tolist(), labels.tolist())) == want
