import zlib

import duckdb
import numpy as np
import pytest

from nearfield.llm import quality
from tests.llm.helpers import EDGES, documents


def brute_marginals(score, transition):
    """All labellings of one document."""
    n = len(score)
    z, good = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        w = np.exp(sum(s for s, v in zip(score, y) if v) + sum(transition[a, b] for a, b in zip(y, y[1:])))
        z += w
        good += w * np.array(y)
    return good / z


def test_forward_backward_equals_enumeration():
    g = np.random.default_rng(0)
    t = g.normal(size=(2, 2))
    lengths = [1, 5, 3, 7, 2]
    score = g.normal(size=sum(lengths)) * 2
    first = np.cumsum([0, *lengths])
    got, pairs = quality.forward_backward(score, first, t)
    want = np.concatenate([brute_marginals(score[a:z], t) for a, z in zip(first, first[1:])])
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert abs(pairs.sum() - sum(n - 1 for n in lengths)) < 1e-9


def test_lines_and_features():
    f = quality.line_features(["One two.\n\nTHREE!!", None, "", "a a a a\na a a a"])
    assert f.first.tolist() == [0, 3, 4, 5, 7]
    assert f.weight.tolist() == [7, 0, 7, 0, 0, 4, 4]
    assert f.x[5, 14] == 1 and f.x[0, 14] == 0  # repeated lines
    assert f.x[5, 11] == pytest.approx(0.75)  # repeated words
    assert f.x[0, 15] == 1 and f.x[0, 16] == 1 and f.x[2, 7] == pytest.approx(2 / 7)


def test_parts_give_the_same_features(monkeypatch):
    texts = [t for _, t, *_ in EDGES]
    whole = quality.line_features(texts)
    monkeypatch.setattr(quality, "PART_BYTES", 10)
    parts = quality.line_features(texts)
    np.testing.assert_array_equal(whole.first, parts.first)
    np.testing.assert_allclose(whole.x, parts.x)


def test_held_out_accuracy(sf_dir):
    """The smallest tables label too few documents to hold some out; the next larger ones are used."""
    d = sf_dir.replace("sf0.001", "sf0.01")
    rows = duckdb.execute(f"SELECT doc_id, quality, text FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    field = quality.fit([r[2] for r in own], np.array([r[1] for r in own]))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    score, _ = field.scores(quality.line_features([r[2] for r in held]))
    assert np.mean((score >= 0.3) == np.array([r[1] == 1 for r in held])) > 0.95


def test_degenerate_training():
    assert quality.fit([], np.array([])).scores(quality.line_features(["x", None]))[0].tolist() == [0.5, 0.5]
    only = quality.fit(["a b", "c"], np.array([1, 1]))
    assert (only.scores(quality.line_features(["x", ""]))[0] > 0.99).all()


def test_operator_on_edges_and_empty_tables(spark):
    df = documents(spark, EDGES)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 0, 0), (6, 0, None), (9, None, 0), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    field = quality.fit(*quality.labelled_sample(df, labels, lambda c: c.isNotNull()))
    rows = quality.score(df, field).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] == pytest.approx(2 / 3)
    assert quality.label_lines(df, field).count() == sum(r["n_lines"] for r in rows)
    kept = quality.keep(df, field, threshold=0.0)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    empty = documents(spark, [])
    assert quality.score(empty, field).collect() == [] == quality.keep(empty, field).collect()
    assert quality.labelled_sample(empty, labels, lambda c: c.isNotNull())[0] == []


def test_query_columns(spark, sf_dir):
    rows = quality.query(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def plain_features(text):
    """Features of each line of one text by plain loops."""
    lines = [line.split() for line in (text or "").encode().split(b"\n")]
    lower = [tuple(w.lower() for w in words) for words in lines]
    out = []
    for words, own in zip(lines, lower):
        data = b"".join(words)
        n, m = len(data), len(words)
        kinds = [0] * 8
        for b in data:
            c = chr(b)
            k = 7 if b >= 0x80 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c == "|" else 4 if c == "!" else 5 if c in ".,;:?'\"-()" else 6
            kinds[k] += 1
        x = [np.log1p(n), np.log1p(m), n / max(m, 1), *(k / max(n, 1) for k in kinds)]
        x += [sum(own[i] == own[i - lag] for i in range(lag, m)) / max(m, 1) for lag in (1, 2, 3)]
        x += [float(m > 0 and lower.count(own) > 1), float(m > 0 and words[0][:1].isupper()), float(m > 0 and data[-1:] in (b".", b"!", b"?"))]
        out.append((x, n))
    return out


def test_features_and_scores_equal_plain_loops(duck):
    rows = duck.execute("SELECT text FROM documents ORDER BY doc_id LIMIT 60").fetchall()
    texts = [t for (t,) in rows] + [None, "", "\n\n", "A a A a\na A a A\n\n| x | y |\r\nWAIT!!! 12,5 \t end."]
    lines = quality.line_features(texts)
    want = [f for t in texts for f in plain_features(t)]
    assert len(want) == len(lines.weight) and [n for _, n in want] == lines.weight.tolist()
    np.testing.assert_allclose(lines.x, np.array([x for x, _ in want], np.float32), rtol=1e-5, atol=1e-6)
    g = np.random.default_rng(1)
    field = quality.fit(texts[:40], g.integers(0, 2, 40))
    score, good = field.scores(lines)
    for i, t in enumerate(texts):
        a, z = lines.first[i], lines.first[i + 1]
        if z - a > 12:
            continue
        own = quality.line_features([t])
        emit = field.w[field.bins(own)].sum(1)
        p = brute_marginals(emit, field.transition)
        np.testing.assert_allclose(good[a:z], p, atol=1e-9)
        total = own.weight.sum()
        if total:
            bad = float((own.weight * (1 - p)).sum() / total)
            z_ = field.curve @ np.array([1, bad, np.log(bad + 1e-3)])
            assert score[i] == pytest.approx(1 / (1 + np.exp(-z_)), abs=1e-9)
        else:
            assert score[i] == field.prior


def test_a_repeated_id_trains_once(spark):
    df = documents(spark, [(1, f"text {i}", "en", "s") for i in range(30)] + [(2, None, "en", "s")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    texts, own = quality.labelled_sample(df, labels, lambda c: c.isNotNull())
    assert texts == ["text 0", ""] and own.tolist() == [1, 0]


def test_very_long_texts():
    lines = quality.line_features(["a line of words\n" * 60_000, "x" * 2_000_000])
    field = quality.fit(["good words here.", "bad|bad|bad !!!"] * 20, np.array([1, 0] * 20))
    score, good = field.scores(lines)
    assert len(good) == 60_002 and ((0 <= score) & (score <= 1)).all()
