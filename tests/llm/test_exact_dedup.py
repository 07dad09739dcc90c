import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import exact_dedup as x
from tests.llm.helpers import EDGES, WHITE, documents


def brute(rows):
    norm = [(d, re.sub(WHITE, " ", t or "")) for d, t, *_ in rows]
    groups = {}
    for d, n in norm:
        groups.setdefault(n, []).append(d)
    out = []
    for d, n in norm:
        g = groups[n]
        keep = min((i for i in g if i is not None), default=None) if len(g) > 1 else d
        out.append((d, keep, len(g), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, x.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_edges_equal_brute_force(spark):
    assert run(documents(spark, EDGES)) == brute(EDGES)


def test_white_space_alone_makes_no_difference(spark):
    rows = [(5, "a  b", "en", "s"), (3, "a\t\nb", "en", "s"), (4, "a b", "en", "s"), (1, "ab", "en", "s"), (2, " a b", "en", "s")]
    got = run(documents(spark, rows))
    assert got == brute(rows) and [g for g in got if g[0] == 5][0][1:4] == (3, 3, False)


def test_hot_group_and_many_copies(spark):
    rows = [(i, f"text {i % 7 if i % 3 else 0}", "en", "s") for i in range(600)]
    assert run(documents(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert x.exact_dedup(documents(spark, [])).collect() == []


def test_every_partitioning_gives_the_same(spark):
    df = documents(spark, EDGES * 3)
    assert run(df.repartition(1)) == run(df.repartition(9)) == brute(EDGES * 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 60) - 1) | st.integers(0, 40), max_size=60), min_size=1, max_size=5))
def test_filters_merge_without_loss(parts):
    def build(values):
        k, n = np.unique(np.array(values, np.uint64), return_counts=True)
        return x.CountingQuotientFilter.build(k, n.astype(np.int64), 60)

    filters = [x.CountingQuotientFilter.from_bytes(build(p).to_bytes()) for p in parts]
    keys, counts = x.CountingQuotientFilter.merge(filters).items()
    k, n = np.unique(np.array([v for p in parts for v in p], np.uint64), return_counts=True)
    assert keys.tolist() == k.tolist() and counts.tolist() == n.tolist()


def test_equal_fingerprints_still_differ_by_bytes(spark, monkeypatch):
    """With a fingerprint of few bits unrelated texts collide; verification keeps them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(x, "_fingerprint", lambda text: F.lit(0).cast("long"))
    monkeypatch.setattr(x, "repeated_fingerprints", lambda f, rows: f.sparkSession.createDataFrame([(0, 2)], "fingerprint long, n long"))
    rows = [(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "a", "en", "s")]
    assert run(documents(spark, rows)) == brute(rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_matches_sql(sf, same_rows):
    same_rows(x.query, x.SQL)


def test_rows_that_stay(spark):
    rows = [(1, "same text here", "en", "a"), (2, "same  text here", "en", "a"), (2, "a second unique text", "en", "a"), (3, "twice", "en", "a"), (3, "twice", "en", "a"), (None, "null id", "en", "a"), (None, "null  id", "en", "a"), (9, None, None, None), (4, " ", "en", "b"), (8, "", "en", "b"), (None, "twice", "en", "b")]
    df = documents(spark, rows).withColumnRenamed("size", "_may").withColumnRenamed("lang", "_norm")
    kept = x.keep(df)
    assert kept.columns == df.columns and set(map(str, kept.collect())) <= set(map(str, df.collect()))
    got = sorted(((r["doc_id"], re.sub(WHITE, " ", r["text"] or "")) for r in kept.collect()), key=str)
    assert got == sorted([(1, "same text here"), (2, "a second unique text"), (3, "twice"), (None, "null id"), (8, ""), (4, " ")], key=str)
    assert x.keep(documents(spark, [])).collect() == []
    assert sorted(map(str, x.keep(df.repartition(3)).collect())) == sorted(map(str, kept.collect()))


def test_rows_that_stay_agree_with_the_decisions(spark):
    rows = [(i, f"text {i % 7 if i % 3 else 0}" if i % 2 else f"alone {i}", "en", "s") for i in range(300)]
    df = documents(spark, rows)
    assert {r["doc_id"] for r in x.keep(df).collect()} == {r["doc_id"] for r in x.exact_dedup(df).where("kept").collect()}
