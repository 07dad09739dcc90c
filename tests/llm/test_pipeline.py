import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from nearfield.llm import exact_dedup, mixing, near_dup, quality
from nearfield.session import materialise
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_exact_dedup import brute as exact_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    field = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "test")
        tables.append(docs)
    good, exact, near, mixed, encoded = tables
    for t in tables[:-1]:
        assert t.columns == COLUMNS
        assert all(before[r["doc_id"]] == r for r in t.collect())
    score, _ = field.scores(quality.line_features([r["text"] for r in before.values()]))
    assert {r["doc_id"] for r in good.collect()} == {d for d, s in zip(before, np.array(score)) if s >= quality.THRESHOLD}
    kept = {d for d, _, _, k, _ in exact_brute([(r["doc_id"], r["text"]) for r in good.collect()]) if k}
    assert {r["doc_id"] for r in exact.collect()} == kept
    kept = {d for d, _, _, k in near_brute([(r["doc_id"], r["text"]) for r in exact.collect()], 5) if k}
    assert {r["doc_id"] for r in near.collect()} == kept
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(near).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert encoded.count() == mixed.count()


def test_run_equals_its_stages(spark, sf_dir):
    rows = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert rows == sorted(map(tuple, entry.queries()["pipeline"](spark, sf_dir).collect())) and rows


def test_stages_bear_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "test")
        assert docs.count() == 0


def test_stages_bear_nulls_and_other_columns(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text here", None, None, 1), (4, "same  text here", "en", "a", 1), (5, "other " * 3000, "en", "b", 2)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, norm string, copies long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "test")
        assert docs.columns == [*COLUMNS, "norm", "copies"]
    assert 4 not in {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == docs.count()


def test_rows_with_repeated_and_null_ids(spark, sf_dir):
    """No unique text is lost, no exact or near copy stays, and each source comes within one document of its target."""
    w = [f"word{i}" for i in range(40)]
    near = " ".join([*w[:-1], "changed"])
    rows = [(1, "same text here"), (2, "same  text here"), (2, "a second unique text"), (3, " ".join(w)), (3, " ".join(w)), (3, near), (None, "nobody's text"), (None, "nobody's text"), (None, "another one of nobody")]
    rows = [(d, t, "en", s, 1, 5, "r") for s in ("a", "b") for d, t in [(d, f"{t} {s}" if t else t) for d, t in rows]] + [(i % 11, f"filler number {i} of the table", "en", "ab"[i % 2], 1, 5, "r") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _copy long, _row string")
    columns = docs.columns
    exact = materialise(corpus_pipeline.drop_exact_copies(spark, docs, sf_dir), "test")
    texts = [" ".join(r["text"].split()) for r in exact.collect()]
    assert len(set(texts)) == len(texts) and set(texts) == {" ".join(r[1].split()) for r in rows}
    alone = materialise(corpus_pipeline.drop_near_copies(spark, exact, sf_dir), "test")
    kept = {r["text"] for r in alone.collect()}
    assert alone.columns == columns and len(kept) == alone.count()
    gone = {t for t in texts if t not in {" ".join(k.split()) for k in kept}}
    assert len(gone) == 3 and all("word0" in t for t in gone)  # of four variants of one text one stays
    mixed = materialise(corpus_pipeline.mix_sources(spark, alone, sf_dir), "test")
    assert mixed.columns == columns and {r["_copy"] for r in mixed.collect()} == {5}
    taken, largest = {}, {}
    for r in mixed.collect():
        n = len(r["text"].split())
        taken[r["source"]] = taken.get(r["source"], 0) + n
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    target = {r["source"]: r["target"] for r in mixing.mix(alone).collect()}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    encoded = corpus_pipeline.encode(spark, mixed, sf_dir)
    assert encoded.count() == mixed.count()


def test_encoding_equals_the_library(spark, sf_dir):
    import hashlib
    import struct

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in corpus_pipeline.encode(spark, docs, sf_dir).collect():
        ids = sp.encode(text[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_registered_names():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert exact_dedup and near_dup
