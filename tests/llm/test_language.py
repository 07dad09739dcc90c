import zlib

import numpy as np
import pytest

from nearfield.llm import language
from tests.llm.helpers import EDGES, documents


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, lang, text FROM documents ORDER BY doc_id").fetchall()


def test_held_out_accuracy(texts):
    own = [r for r in texts if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    held = [r for r in texts if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    model = language.fit([r[2] for r in own], [r[1] for r in own])
    got, score, rejected = model.predict([r[2] for r in held])
    right = np.array([g == r[1] for g, r in zip(got, held)])
    assert right.mean() > 0.95
    assert right[~rejected].mean() > 0.95
    assert ((0 <= score) & (score <= 1)).all()


def test_texts_without_letters_are_unknown(texts):
    model = language.fit([r[2] for r in texts[:60]], [r[1] for r in texts[:60]])
    got, score, rejected = model.predict([None, "", "  ", "123 !!", "漢"])
    assert got[:4] == ["und"] * 4 and score[:4].tolist() == [0] * 4 and rejected[:4].all() and got[4] != "und"


def test_parts_give_what_single_texts_give(monkeypatch):
    texts = ["Hello World", None, "", "née", "x", "a b c", "ß" * 30]
    whole = [(b.tolist(), f.tolist(), h.tolist()) for b, f, h in language.subwords(texts)]
    assert len(whole) == 1
    buckets, first, has = whole[0]
    for i, t in enumerate(texts):
        ((b, f, h),) = language.subwords([t])
        assert sorted(b.tolist()) == sorted(buckets[first[i] : first[i + 1]]) and h.tolist() == [has[i]]
    monkeypatch.setattr(language, "PART_CHARS", 3)
    assert sum(len(b) for b, _, _ in language.subwords(texts)) == len(buckets)


def test_one_language_and_none():
    model = language.fit(["abc"], ["en"])
    assert model.predict(["xyz", "1"])[0] == ["en", "und"]
    none = language.fit([], [])
    assert none.predict(["xyz"]) [0] == ["und"]


def test_operator_on_edges_and_empty_tables(spark):
    df = documents(spark, EDGES)
    model = language.fit(*language.labelled_sample(df, lambda c: c.isNotNull()))
    rows = language.predict(df, model).collect()
    assert len(rows) == len(EDGES) and {r["lang_pred"] for r in rows} <= {"en", "de", "es", "und"}
    empty = documents(spark, [])
    none = language.fit(*language.labelled_sample(empty, lambda c: c.isNotNull()))
    assert language.predict(empty, none).collect() == []
    assert {r["lang_pred"] for r in language.predict(df, none).collect()} == {"und"}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [(i, f"text {i}", "en" if i % 10 else "de", "s") for i in range(300)]
    texts, langs = language.labelled_sample(documents(spark, rows), lambda c: c.isNotNull())
    assert len(texts) == 20 and langs.count("de") == 10


def test_query_columns(spark, sf_dir):
    rows = language.query(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def brute_buckets(text):
    """Windows of two, three and four characters by a plain loop."""
    s = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    out = []
    for n in language.SIZES:
        for i in range(len(s) - n + 1):
            w = s[i : i + n]
            if (n == 2 and w.strip()) or (n > 2 and w[1:-1].isalpha()):
                h = ord(w[0]) * 0x9E3779B1 & 0xFFFFFFFF
                for j, f in zip(range(1, n), (0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
                    h = (h ^ (h >> 15) ^ ord(w[j])) * f & 0xFFFFFFFF
                h ^= h >> 13
                out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
    return out


def test_predictions_equal_a_plain_loop(texts):
    own = texts[:80]
    model = language.fit([r[2] for r in own], [r[1] for r in own])
    sample = [r[2] for r in texts[80:140]] + [None, "", "12 34", "a", "É ß 漢字", "x1y2z"]
    got, score, rejected = model.predict(sample)
    for t, g, s, r in zip(sample, got, score, rejected):
        b = brute_buckets(t)
        if not b:
            assert (g, s, r) == ("und", 0.0, True)
            continue
        z = [(sum(float(model.table[k][i]) for i in b) / len(b) + model.bias[k]) / model.temperature for k in range(len(model.names))]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        assert g == model.names[int(p.argmax())] and abs(s - p.max()) < 1e-4 and r == (s < model.least)


def test_a_repeated_id_trains_once(spark):
    rows = [(1, f"text {i}", "en", "s") for i in range(50)] + [(2, "ein satz", "de", "s"), (2, None, "de", "s")]
    texts, langs = language.labelled_sample(documents(spark, rows), lambda c: c.isNotNull())
    assert sorted(zip(langs, texts)) == [("de", ""), ("en", "text 0")]


def test_very_long_texts_in_pieces(texts, monkeypatch):
    model = language.fit([r[2] for r in texts[:60]], [r[1] for r in texts[:60]])
    sample = [(r[2] + " ") * 3 for r in texts[60:75]] + ["x" * 5000, "a" * 700 + " b", "", None, " " * 900, "İstanbul " * 200]
    whole, known = model.logits(sample)
    monkeypatch.setattr(language, "PART_CHARS", 300)
    assert len(language.pieces_of(sample[0])) > 1 and language.pieces_of("x" * 5000) == ["x" * 5000]
    parts, known_too = model.logits(sample)
    np.testing.assert_allclose(parts, whole, atol=1e-6)
    assert known.tolist() == known_too.tolist()
    monkeypatch.undo()
    assert model.predict(["the quick brown fox " * 200_000])[1][0] > 0
