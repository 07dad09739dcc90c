"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, word repetition and line shape, in
bins, of the line itself and of the lines before and after it. Transitions couple neighbouring
labels. Forward-backward marginals, weighted by line length, give a document its share of bad text, and a logistic curve
maps that share to the probability that the document's label is 1.

Labels exist for documents only. Training starts with every line bearing its document's label; then lines of a
bad document that the field holds to be good become good, unless no bad line would be left, and the field is
trained on. Training takes a sample of at most :data:`SAMPLE` labelled documents in the order of a hash of their
doc_id, so it takes the same memory on the driver at every size. Everything else covers all rows.

Defined cases. A null text counts as empty. An empty text, or one of white space only, has no weight on any line and scores the
share of label 1 in the sample. Without any labelled row, or with one label only, each document scores that share (0.5 without
rows). A document with several labels takes the rounded mean; of rows that repeat a doc_id the smallest text trains. Rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.runs import trimmed
from nearfield.llm.shingles import mix64, word_hashes
from nearfield.sampling import smallest_hashes
from nearfield.session import ship

#: Labelled documents that training takes at most.
SAMPLE = 6000
BINS, EDGE = 9, 8  # the last bin marks a neighbour beyond the document
_CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)  # other signs
_CLASS[0x80:] = 8
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord("|")] = 4
_CLASS[ord("!")] = 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6
_FEATURES = 17
#: Bytes of text whose features are computed at once.
PART_BYTES = 300_000


@dataclass
class Lines:
    """Lines of some texts: features, lengths in bytes, and the position of each document's first line."""

    x: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def line_features(texts: list[str | None]) -> Lines:
    parts, part, size = [], [], 0
    for t in texts:
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= PART_BYTES:
            parts.append(_features(part))
            part, size = [], 0
    if part:
        parts.append(_features(part))
    if not parts:
        return Lines(np.zeros((0, _FEATURES), np.float32), np.zeros(0), np.zeros(1, np.int64))
    lines = [len(p.weight) for p in parts]
    first = np.concatenate([p.first[:-1] + before for p, before in zip(parts, np.cumsum([0, *lines[:-1]]), strict=True)])
    return Lines(np.concatenate([p.x for p in parts]), np.concatenate([p.weight for p in parts]), np.append(first, sum(lines)))


def _features(texts: list[bytes]) -> Lines:
    data = b"\n".join(texts)
    b = np.frombuffer(data, np.uint8)
    line_of = np.cumsum(b == 10, dtype=np.int32) if len(b) else np.zeros(0, np.int32)
    n = int(line_of[-1]) + 1 if len(b) else 1
    first = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
    counts = np.bincount(line_of.astype(np.int64) * _CLASSES + _CLASS[b], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float32)
    counts[1:, 0] -= 1  # a line's break is counted with the line after it
    ink = counts[:, 1:].sum(1)
    hashes, starts = word_hashes(data)
    line = line_of[starts] if len(starts) else np.zeros(0, np.int32)
    words = np.bincount(line, minlength=n).astype(np.float32)
    x = np.zeros((n, _FEATURES), np.float32)
    x[:, 0] = np.log1p(ink)
    x[:, 1] = np.log1p(words)
    x[:, 2] = ink / np.maximum(words, 1)
    x[:, 3:11] = counts[:, 1:] / np.maximum(ink, 1)[:, None]
    for lag in (1, 2, 3):
        again = (hashes[lag:] == hashes[:-lag]) & (line[lag:] == line[:-lag])
        x[:, 10 + lag] = np.bincount(line[lag:][again], minlength=n) / np.maximum(words, 1)
    if len(starts):
        head = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        place = np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))
        own = np.add.reduceat(mix64(hashes + mix64(place.astype(np.uint64))), head)
        doc = np.searchsorted(first, line[head], side="right").astype(np.uint64)
        _, at, times = np.unique(mix64(own ^ mix64(doc)), return_inverse=True, return_counts=True)
        x[line[head], 14] = times[at] > 1
        x[line[head], 15] = (b[starts[head]] >= ord("A")) & (b[starts[head]] <= ord("Z"))
        black = np.flatnonzero(_CLASS[b] != 0)
        last = black[np.append(np.diff(line_of[black]) != 0, True)]
        x[line_of[last], 16] = np.isin(b[last], [ord(c) for c in ".!?"])
    return Lines(x, ink.astype(np.float64), first)


@dataclass
class Field:
    """Bin edges, weights of a good label by feature place and bin, log transition scores, and the logistic curve."""

    edges: list[np.ndarray]
    w: np.ndarray
    transition: np.ndarray
    curve: np.ndarray
    prior: float

    def bins(self, lines: Lines) -> np.ndarray:
        """Positions in ``w`` of each line: own bins, then those of the line before and the line after."""
        n = len(lines.weight)
        own = np.empty((n, _FEATURES), np.int64)
        for f, e in enumerate(self.edges):
            own[:, f] = np.searchsorted(e, lines.x[:, f], side="right")
        before, after = np.full_like(own, EDGE), np.full_like(own, EDGE)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[lines.first[:-1]] = EDGE
        after[lines.first[1:] - 1] = EDGE
        return np.concatenate([own, before, after], 1) + np.arange(3 * _FEATURES) * BINS

    def marginals(self, lines: Lines, bins: np.ndarray | None = None) -> np.ndarray:
        """The probability that each line is good."""
        return forward_backward(self.w[self.bins(lines) if bins is None else bins].sum(1), lines.first, self.transition)[0]

    def scores(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Document scores, and the lines' probabilities of being good."""
        good = self.marginals(lines) if len(lines.weight) else np.zeros(0)
        return self.from_share(_bad_share(good, lines)), good

    def from_share(self, bad: np.ndarray) -> np.ndarray:
        out = _sigmoid(_curve_inputs(np.nan_to_num(bad)) @ self.curve)
        return np.where(np.isnan(bad), self.prior, out)


def _bad_share(good: np.ndarray, lines: Lines) -> np.ndarray:
    """Share of a document's text that stands in bad lines, by marginals; NaN without text."""
    if not len(lines.first) - 1:
        return np.zeros(0)
    total = np.add.reduceat(lines.weight, lines.first[:-1])
    bad = np.add.reduceat(lines.weight * (1 - good), lines.first[:-1])
    return np.where(total > 0, bad / np.maximum(total, 1), np.nan)


def _curve_inputs(bad: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(bad), bad, np.log(bad + 1e-3)], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


def forward_backward(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected number of each transition). Documents advance together, longest first."""
    n = len(score)
    emit = np.stack([_sigmoid(-score), _sigmoid(score)], 1)
    t = np.exp(transition - transition.max())
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left") if steps else []
    alpha, beta = np.ones((n, 2)), np.ones((n, 2))
    for s in range(steps):
        at = start[: active[s]] + s
        a = emit[at] if s == 0 else (alpha[at - 1] @ t) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for s in range(steps - 2, -1, -1):
        at = start[: active[s + 1]] + s
        ahead = emit[at + 1] * beta[at + 1]
        b = ahead @ t.T
        joint = alpha[at][:, :, None] * t * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 3, steps: int = 60) -> Field:
    """Trains a field on whole texts and their labels, 1 for good."""
    labels = np.asarray(labels, np.int64)
    prior = float(labels.mean()) if len(labels) else 0.5
    lines = line_features(texts)
    edges = []
    for f in range(_FEATURES):
        v = lines.x[:, f]
        e = np.unique(np.quantile(v, np.linspace(0, 1, 12)[1:-1])) if len(v) else np.zeros(1)
        e = np.append(e[e > 0][:: max(1, len(e[e > 0]) // 5)][:6], np.nextafter(np.float32(0), np.float32(1)))
        edges.append(np.unique(e.astype(np.float32)))
    field = Field(edges, np.zeros(3 * _FEATURES * BINS), np.zeros((2, 2)), np.zeros(3), prior)
    if len(set(labels.tolist())) < 2:
        field.curve[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return field
    bins = field.bins(lines)
    doc = np.repeat(np.arange(len(labels)), np.diff(lines.first))
    inked = lines.weight > 0
    y = labels[doc]
    inner = np.ones(len(y), bool)
    inner[lines.first[:-1]] = False
    m = [np.zeros_like(field.w), np.zeros((2, 2))]
    v = [np.zeros_like(field.w), np.zeros((2, 2))]
    n = 0
    for r in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        for _ in range(steps):
            n += 1
            good, pairs = forward_backward(field.w[bins].sum(1), lines.first, field.transition)
            gradient = [np.bincount(bins.ravel(), np.repeat(y - good, bins.shape[1]), len(field.w)) / len(y) - 1e-4 * field.w, (seen - pairs) / len(y) - 1e-4 * field.transition]
            for i, (p, g) in enumerate(zip((field.w, field.transition), gradient, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p += 0.1 * (m[i] / (1 - 0.9**n)) / (np.sqrt(v[i] / (1 - 0.99**n)) + 1e-8)
        good = field.marginals(lines, bins)
        if r + 1 < rounds:  # good lines of bad documents become good where a bad line stays
            keeps = (good < 0.5) & inked
            has = np.zeros(len(labels), bool)
            has[doc[keeps]] = True
            y = np.where((labels[doc] == 0) & has[doc], (good >= 0.5).astype(np.int64), labels[doc])
    bad = _bad_share(good, lines)
    field.curve = _logistic(_curve_inputs(bad[~np.isnan(bad)]), labels[~np.isnan(bad)])
    return field


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, where, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of at most ``sample`` documents, those with the smallest hashes of their ids. ``where`` picks ids."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & where(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    own = smallest_hashes(own, ["doc_id"], sample)  # the bound of what is broadcast and collected
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
    # Rows that repeat an id give one text, so at most ``sample`` texts are collected.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id", kind="stable")
    return rows["text"].tolist(), rows["label"].to_numpy(np.int64)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, n_bad), a row for each row of docs."""
    ship(docs.sparkSession)
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                lines = line_features(b.column(1).to_pylist())
                scores, good = field.scores(lines)
                bad = np.add.reduceat(((good < 0.5) & (lines.weight > 0)).astype(np.int64), lines.first[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(np.diff(lines.first)), pa.array(bad)], ["doc_id", "score", "n_lines", "n_bad"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), f"doc_id {id_type}, score double, n_lines long, n_bad long")


def label_lines(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, good, p_good), a row for each line of each row of docs; lines count from 0."""
    ship(docs.sparkSession)
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                lines = line_features(b.column(1).to_pylist())
                good = field.marginals(lines)
                n = np.diff(lines.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.arange(len(good)) - np.repeat(lines.first[:-1], n)), pa.array(good >= 0.5), pa.array(good)], ["doc_id", "line", "good", "p_good"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), f"doc_id {id_type}, line long, good boolean, p_good double")


def keep(docs: DataFrame, field: Field, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold."""
    ship(docs.sparkSession)
    least = THRESHOLD if threshold is None else threshold
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                scores, _ = field.scores(line_features(b.column(at).to_pylist()))
                yield b.filter(pa.array(scores >= least))

    return docs.mapInArrow(trimmed(run), docs.schema)


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Documents that score less are rejected.
THRESHOLD = 0.3


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    """A field of the labels whose documents are not held out."""
    return fit(*labelled_sample(docs, labels, lambda c: remainder(c, 5) != 0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, field)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_bad")
