import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from nearfield.llm import pieces
from tests.llm.helpers import EDGES, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts_equal_the_library(library):
    g = random.Random(7)
    letters = list(" ▁abcdefghinorst.,0123\n\t\x00éñ漢字😀́​<s></s>\r�ﬁ'\"-_(){}")
    m = pieces.pieces(MODEL)
    for _ in range(4000):
        t = "".join(g.choice(letters) for _ in range(g.randint(0, 40)))
        want = library.encode(t)
        assert m.encode(t) == want, t
        assert m.encoded(t)[1] == library.decode(want) == m.decode(want), t


def test_long_texts_without_spaces(library):
    m = pieces.pieces(MODEL)
    for t in ("a" * 5000, "abc" * 3000, "\n" * 400, " " * 777, "漢" * 500, "aé" * 900, "http://" * 300):
        assert m.encode(t) == library.encode(t)


def test_random_ids_decode_like_the_library(library):
    g = random.Random(9)
    m = pieces.pieces(MODEL)
    for _ in range(3000):
        ids = [g.randrange(32000) if g.random() < 0.5 else g.randrange(259) for _ in range(g.randint(0, 9))]
        assert m.decode(ids) == library.decode(ids), ids


def test_bounded_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 5)
    m = pieces.Pieces(MODEL)
    t = "The quick brown fox jumps over the lazy dog; she sells sea shells. " * 5
    assert m.encode(t) == library.encode(t) and len(m.table) + len(m.table.old) <= 5 and len(m.pairs) <= 5


def test_operator_on_edges(spark, library):
    df = documents(spark, EDGES)
    got = sorted((tuple(r) for r in pieces.encode(df, MODEL, with_digests=True, with_ids=False).collect()), key=str)
    want = []
    for d, t, *_ in EDGES:
        ids = library.encode(t or "")
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_then_decode(spark):
    df = documents(spark, EDGES)
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(df, MODEL), MODEL).collect()}
    assert back == {(d, t or "") for d, t, *_ in EDGES}
    assert pieces.encode(documents(spark, []), MODEL).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nulls, MODEL).first()["text"] == ""


def ended(library, d, t):
    ids = library.encode(t or "", add_bos=True, add_eos=True)
    data = b"".join(i.to_bytes(4, "little") for i in ids)
    return d, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_begin_and_end_ids(spark, library):
    df = documents(spark, EDGES)
    got = pieces.encode(df, MODEL, with_ends=True)
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=str) == sorted(((d, library.encode(t or "", add_bos=True, add_eos=True)) for d, t, *_ in EDGES), key=str)
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(got, MODEL).collect()}
    assert back == {(d, t or "") for d, t, *_ in EDGES}


def test_query_and_stage_give_begin_and_end_ids(spark, library, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, pieces.query(spark, sf_dir).collect())) == sorted(ended(library, d, t) for d, t in rows)
    edges = corpus_pipeline.encode(spark, documents(spark, EDGES), sf_dir)
    assert sorted(map(tuple, edges.collect()), key=str) == sorted((ended(library, d, t) for d, t, *_ in EDGES), key=str)
