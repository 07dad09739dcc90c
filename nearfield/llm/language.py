"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its subwords: sequences of :data:`SIZES` characters of its lower-cased words,
word ends included, hashed into :data:`BUCKETS` rows. Embeddings and softmax are trained together by stochastic gradient
descent in NumPy. A temperature, fitted on texts that training did not see, makes the largest probability the chance of being
right; texts whose score is under the lowest score at which at most :data:`RISK` of those texts are wrong are marked rejected.

For prediction the softmax is applied to the embeddings once, so a text costs one table row of class scores a subword.

Training takes at most :data:`SAMPLE` texts and at most :data:`PER_LANGUAGE` of a language, those with the smallest hashes of their
ids. All else covers every row and whole texts.

Defined cases. A text that is null or has no letter is ``und`` with score 0 and rejected. Without any labelled row all texts
are ``und``. Of rows that repeat an id and a language the smallest text trains. With one language all other texts get it with score 1. Ties go to the language that sorts first.
Rows are predicted one by one, so repeated rows get equal results; language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.quality import remainder
from nearfield.runs import trimmed
from nearfield.sampling import uniform
from nearfield.session import materialise, ship

SIZES = (2, 3, 4)
BUCKETS, WIDTH = 1 << 16, 16
#: Texts that training takes at most, in all and of one language.
SAMPLE, PER_LANGUAGE = 6000, 900
#: Share of accepted texts that may be wrong.
RISK = 0.02
#: Characters that are hashed at once.
PART_CHARS = 300_000
UNKNOWN = "und"
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def subwords(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the texts: (bucket of each subword, first subword of each text, whether each text has a letter)."""
    part, size = [], 0
    for t in texts:
        part.append((t or "").lower())
        size += len(part[-1])
        if size >= PART_CHARS:
            yield _hashed(part)
            part, size = [], 0
    if part:
        yield _hashed(part)


def pieces_of(text: str | None) -> list[str]:
    """A text in pieces of about :data:`PART_CHARS`. They part at a character that is no letter, so their subwords together are the text's."""
    text = (text or "").lower()
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        cut = next((i for i in range(at + PART_CHARS, len(text)) if not text[i].isalpha()), len(text))
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]] if at <= len(text) else out


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(0x20)).astype(np.uint32)
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])  # a text owns the space before it
    buckets, at = [], []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        ok = letter[1 : 1 + m] if n == 2 else letter[1 : 1 + m].copy()
        if n == 2:
            ok = letter[:m] | letter[1 : 1 + m]
        for j in range(2, n - 1):
            ok &= letter[j : j + m]
        i = np.flatnonzero(ok)
        h = c[i] * _FACTORS[0]
        for j in range(1, n):
            h = (h ^ (h >> np.uint32(15)) ^ c[i + j]) * _FACTORS[j]
        h ^= h >> np.uint32(13)
        buckets.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64))
        at.append(i)
    has = np.array([bool(letter[a + 1 : z].any()) for a, z in zip(start[:-1], start[1:], strict=True)], bool)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), has
    counts = [np.searchsorted(i, start) for i in at]
    # Subwords of a text stand together: the three sizes one after the other.
    sizes = np.stack([np.diff(x) for x in counts])
    first = np.append(0, np.cumsum(sizes.sum(0)))
    out = np.empty(int(first[-1]), np.int64)
    before = np.cumsum(sizes, 0) - sizes
    for b, x, s, o in zip(buckets, counts, sizes, before, strict=True):
        own = b[x[0] : x[-1]]
        out[np.arange(len(own)) - np.repeat(np.cumsum(s) - s, s) + np.repeat(first[:-1] + o, s)] = own
    return out, first, has


@dataclass
class Languages:
    """Class scores of each bucket, class biases, the temperature and the least accepted score."""

    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Class scores of each text, and whether it has a letter. A very long text is added up from pieces."""
        pieces, owner = [], []
        for i, t in enumerate(texts):
            own = pieces_of(t)
            pieces += own
            owner += [i] * len(own)
        at, total, n = 0, np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        known = np.zeros(len(texts), bool)
        for buckets, first, has in subwords(pieces):
            count = np.diff(first)
            of = np.array(owner[at : at + len(count)], np.int64)
            at += len(count)
            full = np.flatnonzero(count)
            for k in range(len(self.names)):
                if len(full):
                    np.add.at(total[:, k], of[full], np.add.reduceat(self.table[k].take(buckets), first[:-1][full], dtype=np.float64))
            np.add.at(n, of, count)
            np.logical_or.at(known, of, has)
        return total / np.maximum(n, 1)[:, None] + self.bias, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        z, known = self.logits(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        score = np.where(known, p[np.arange(len(p)), best], 0.0)
        return [self.names[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], score, ~known | (score < self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str | None], langs: list[str], epochs: int = 6, batch: int = 32, rate: float = 1.0, seed: int = 3) -> Languages:
    """Trains on four texts of five; the fifth sets the temperature and the least accepted score."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    k = len(names)
    if k < 2:
        return Languages(names, np.zeros((k, BUCKETS), np.float32), np.zeros(k), 1.0, 0.0)
    docs = []
    for buckets, first, _ in subwords(texts):
        for a, z in zip(first[:-1], first[1:], strict=True):
            ids, n = np.unique(buckets[a:z], return_counts=True)
            docs.append((ids, (n / max(1, z - a)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    w, bias = np.zeros((k, WIDTH), np.float32), np.zeros(k)
    full = np.array([i for i in range(len(docs)) if len(docs[i][0])], np.int64)
    held = full[full % 5 == 4] if len(full) >= 50 else full
    own = full[full % 5 != 4] if len(full) >= 50 else full
    epochs = max(epochs, -(-400 * batch // max(1, len(own))))  # small samples get as many steps
    steps, step = epochs * -(-len(own) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            ids = np.concatenate([docs[i][0] for i in part])
            share = np.concatenate([docs[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            starts = np.searchsorted(row, np.arange(len(part)))
            v = np.add.reduceat(e[ids] * share[:, None], starts)
            g = _softmax(v @ w.T + bias)
            g[np.arange(len(part)), y[part]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            up = (g @ w).astype(np.float32)
            w -= (lr / len(part) * 8 * (g.T @ v)).astype(np.float32)
            bias -= lr / len(part) * g.sum(0) * 0.1
            np.subtract.at(e, ids, (lr * share)[:, None] * up[row] * 8)
    model = Languages(names, np.ascontiguousarray((e @ w.T).T), bias, 1.0, 0.0)
    z = model.logits([texts[i] for i in held])[0]
    grid = np.geomspace(0.3, 20, 61)
    loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    score, wrong = p.max(1), p.argmax(1) != y[held]
    order = np.argsort(-score, kind="stable")
    fine = np.flatnonzero(np.cumsum(wrong[order]) <= RISK * np.arange(1, len(order) + 1))
    model.least = float(score[order[fine[-1]]]) if len(fine) else 1.1
    return model


def labelled_sample(docs: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and languages of the sample that trains. ``where`` picks ids."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & where(F.col("doc_id")))
    # Rarer languages than the SAMPLE most frequent have no place in the sample, so this is a bounded table.
    counts = materialise(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE), "languages")
    quota = max(1, min(PER_LANGUAGE, SAMPLE // max(1, counts.count())))
    draw = uniform("doc_id")
    # A threshold on the hash leaves little more than the quota of each language, so no task ranks a whole language.
    own = d.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(draw * F.col("n") < F.lit(quota + 8 * quota**0.5 + 50))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))
    own = own.withColumn("place", place).where(F.col("place") <= quota).select("doc_id", "lang")
    # At most SAMPLE ids and languages are broadcast, and as many texts come to the driver.
    own = own.distinct().limit(SAMPLE)
    rows = d.join(F.broadcast(own), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.toPandas().sort_values(["doc_id", "lang"], kind="stable")
    return rows["text"].tolist(), rows["lang"].tolist()


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected), a row for each row of docs."""
    ship(docs.sparkSession)
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one float for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                langs, scores, rejected = shared.value.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*labelled_sample(docs, lambda c: remainder(c, 3) != 1))
    return predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
