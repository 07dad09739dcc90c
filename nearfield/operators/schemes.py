"""Scoring variants that model privacy schemes: scale-and-perturb, trapdoored and blinded products over 2^61 - 1, and linear retrieval.

Each is a distributed plan: rows of the corpus are encoded and scored in Arrow batches where they lie, query-side material
travels with the task in blocks of a bounded size, and a batch gives only its best rows. :func:`top` searches a whole corpus, and
:class:`nearfield.operators.ivf.Index` the clusters that queries are routed to. They model computation and traffic and must not be relied on for protection.
Randomness comes from SHA-256 of a seed and the row's id, so results do not depend on partitioning.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import limb
from nearfield.operators.ivf import answers, best_of, wanted_of
from nearfield.operators.kernels import P61, add61, lift, matmul61, mul61, reduce61, rng, sub61, sum61, to_field, uniform61
from nearfield.operators.knn import BLOCK_BYTES, check_k, kept, matrix, nothing, query_blocks
from nearfield.session import ship


class Scheme(Protocol):
    """What a scoring variant offers. Postings are (cid, vec_id, embedding, ...), queries are (qid, embedding).

    ``value`` is the type of its scores, ``ascending`` whether the smaller is the nearer, ``held`` the column that encoding adds, ``query_bytes`` what
    travels for a query at most.
    """

    name: str
    value: str
    ascending: bool
    held: str
    query_bytes: int

    def encoded(self, postings: DataFrame) -> DataFrame:
        """The postings with what the server holds of each vector."""

    def asking(self, q: np.ndarray) -> "Asking":
        """Encoded queries, a row for each, with the steps from a batch of encoded postings to scores."""


class Asking:
    """Some encoded queries. ``steps`` are (name, function of (rows, places of queries, what the step before gave)); the last gives
    scores, rows x queries, the larger the nearer."""

    steps: tuple = ()

    def best(self, part: pa.RecordBatch, at: np.ndarray, k: int, spent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = None
        for name, step in self.steps:
            began = time.perf_counter()
            out = step(part, at, out)
            spent(name, time.perf_counter() - began)
        place, ids, values = kept(out, part.column("vec_id").to_numpy(), k)
        return at[place], ids, values


def top(scheme: Scheme, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, value): each query's k best of the whole corpus. A batch gives its own k best, and a block of queries travels at a time."""
    check_k(k)
    postings, out = scheme.encoded(corpus.select(F.lit(0).cast("long").alias("cid"), F.col("vec_id").cast("long"), "embedding")), None
    for qids, q in query_blocks(queries, scheme.query_bytes):
        found = answers(postings, qids, {0: np.arange(len(qids))}, scheme.asking(q), k, scheme.value)
        out = found if out is None else out.unionByName(found)
    return nothing(corpus.sparkSession, scheme.value) if out is None else best_of(out, k, scheme.ascending)


def _added(postings: DataFrame, encode, *names: str) -> DataFrame:
    """Postings with binary columns, which ``encode(ids, vectors)`` gives as arrays by row."""
    ship(postings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                arrays = encode(b.column("vec_id").to_numpy(), matrix(b.column("embedding")))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([row.tobytes() for row in x], pa.binary()) for x in arrays)], [*b.schema.names, *names])

    own = postings.select("cid", "vec_id", "embedding")
    kind = own.schema["embedding"].dataType.simpleString()
    return own.mapInArrow(run, f"cid long, vec_id long, embedding {kind}, " + ", ".join(f"{n} binary" for n in names))


def _held(part: pa.RecordBatch, name: str) -> np.ndarray:
    """A binary column of :func:`_added` as rows of unsigned integers."""
    return np.frombuffer(b"".join(part.column(name).to_pylist()), np.uint64).reshape(part.num_rows, -1)


# Scale and perturb


@dataclass(frozen=True)
class ScaleKey:
    scale: float
    seed: str

    def __repr__(self) -> str:  # keys stay out of plans and logs
        return "ScaleKey(...)"


def scale_keygen(low: float = 1.0, high: float = 2.0, seed: int = 42) -> ScaleKey:
    if not 0 < low <= high:
        raise ValueError("scales must be positive and ordered")
    return ScaleKey(float(rng(seed, "scale").uniform(low, high)), f"{seed}-prf")


def ball(g: np.random.Generator, dim: int, radius: float) -> np.ndarray:
    """A uniform point of a ball."""
    v = g.standard_normal(dim)
    return v / np.linalg.norm(v) * radius * g.random() ** (1 / dim)


def scale_encrypt(df: DataFrame, key: ScaleKey, beta: float = 0.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cipher array<double>): scale * m + noise, noise uniform in a ball of radius scale * beta / 4."""
    if beta < 0:
        raise ValueError("beta must not be negative")
    if beta == 0:
        return df.select(F.col(id_col), F.transform(F.col(vector_col), lambda x: F.lit(key.scale) * x.cast("double")).alias("cipher"))
    ship(df.sparkSession)
    scale, seed = key.scale, key.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            rows = [scale * v + ball(rng(seed, i), len(v), scale * beta / 4) for i, v in zip(b.column(0).to_pylist(), x, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "cipher"])

    return df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, f"{id_col} long, cipher array<double>")


# Trapdoored products


@dataclass(frozen=True)
class Trapdoor:
    """Width ell0 of plain rows, width n of encoded ones, split into blocks of b columns."""

    ell0: int = 1024
    n: int = 1292
    b: int = 17
    seed: int = 42

    name, value, ascending, held = "emvp", "long", False, "m"

    def __post_init__(self) -> None:
        if not self.ell0 < self.n or self.n % self.b:
            raise ValueError("need ell0 < n and n a multiple of b")

    @property
    def blocks(self) -> int:
        return self.n // self.b

    def expansion(self) -> np.ndarray:
        """The right part of the generator matrix [I | D]."""
        return uniform61(rng(self.seed, "expansion"), (self.ell0, self.n - self.ell0))

    def mask(self, ids: np.ndarray) -> np.ndarray:
        return np.stack([uniform61(rng(self.seed, "mask", int(i)), self.n) for i in ids]) if len(ids) else np.zeros((0, self.n), np.uint64)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] > self.ell0:
            raise ValueError(f"{x.shape[1]} components do not fit {self.ell0}")
        return np.hstack([to_field(x), np.zeros((len(x), self.ell0 - x.shape[1]), np.uint64)])

    def encrypt(self, ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        m = self._padded(x)
        used = x.shape[1]  # what is padded with zeros adds nothing to the product
        return add61(np.hstack([m, matmul61(m[:, :used], d[:used])]), self.mask(ids))

    def encode(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """(q - D u | u) for random u, a row for each query."""
        v = self._padded(q)
        u = uniform61(rng(self.seed, "query"), (len(q), self.n - self.ell0))
        return np.hstack([sub61(v, matmul61(u, np.ascontiguousarray(d.T))), u])

    def products(self, m: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(blocks, rows, queries): partial products of column blocks, the server's answer."""
        return np.stack([matmul61(m[:, s : s + self.b], np.ascontiguousarray(q[:, s : s + self.b].T)) for s in range(0, self.n, self.b)])

    def decode(self, ids: np.ndarray, partial: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Signed fixed-point inner products, (rows, queries)."""
        return lift(sub61(sum61(partial, 0), matmul61(self.mask(ids), np.ascontiguousarray(q.T))))

    @property
    def query_bytes(self) -> int:
        return self.n * 8

    def encoded(self, postings: DataFrame) -> DataFrame:
        """Adds ``m``, the masked rows."""
        d = self.expansion()
        return _added(postings, lambda ids, x: (self.encrypt(ids, x, d),), "m")

    def asking(self, q: np.ndarray) -> Asking:
        return TrapdoorQueries(self, self.encode(q, self.expansion()))


class TrapdoorQueries(Asking):
    def __init__(self, scheme: Trapdoor, encoded: np.ndarray) -> None:
        self.scheme, self.encoded = scheme, encoded

    @property
    def steps(self) -> tuple:
        return ("server-compute", lambda part, at, _: self.scheme.products(_held(part, "m"), self.encoded[at])), ("decode", lambda part, at, partial: self.scheme.decode(part.column("vec_id").to_numpy(), partial, self.encoded[at]))


def block_partials(scheme: Trapdoor, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, qid, block, part): the server's partial products of rows(vec_id, row) with queries(qid, row), field elements both, by blocks of columns.

    What decoding adds up, for every pair; for inspection, as it is the size of rows times queries. Queries travel in blocks.
    """
    ship(rows.sparkSession)
    out = None
    for qids, q in query_blocks_exact(queries):
        q = _filled(q, scheme.n)

        def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    m = b.column(1).flatten().to_numpy().astype(np.uint64).reshape(b.num_rows, -1)
                    used = -(-m.shape[1] // scheme.b)
                    part = scheme.products(_filled(m, scheme.n), q)[:used]
                    block, row, at = np.meshgrid(np.arange(used), np.arange(b.num_rows), np.arange(len(qids)), indexing="ij")
                    columns = [b.column(0).to_numpy()[row.ravel()], qids[at.ravel()], block.ravel(), part.ravel().astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["vec_id", "qid", "block", "part"])

        found = rows.select(F.col("vec_id").cast("long"), "row").mapInArrow(run, "vec_id long, qid long, block long, part long")
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], "vec_id long, qid long, block long, part long") if out is None else out


def query_blocks_exact(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of queries(qid, row) with rows of integers, which doubles would round."""
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("row"))).first()
    blocks = -(-n * (dim or 0) * 8 // BLOCK_BYTES)
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks).cast("long")) == i).orderBy("qid").toPandas()
        if len(rows):
            yield rows["qid"].to_numpy(np.int64), np.stack(rows["row"].to_numpy()).astype(np.uint64)


def _filled(x: np.ndarray, n: int) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), n - x.shape[1]), np.uint64)])


# Blinded products


def sparse(g: np.random.Generator, n: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions, ascending, and signs of a random sparse vector."""
    at = np.flatnonzero(g.random(n) < rate)
    return at, g.choice(np.array([-1, 1], np.int64), len(at))


def sparse_field(at: np.ndarray, sign: np.ndarray, n: int) -> np.ndarray:
    v = np.zeros(n, np.uint64)
    v[at] = np.where(sign > 0, 1, P61 - 1).astype(np.uint64)
    return v


@dataclass(frozen=True)
class Blinded:
    """Row width n, subspace width n / 2^shrink, sparse rate n^(epsilon - 1), and verification trials."""

    n: int = 1024
    shrink: int = 3
    epsilon: float = 0.5
    trials: int = 3
    seed: int = 42

    name, value, ascending, held = "bntm", "long", False, "m"

    @property
    def n1(self) -> int:
        return self.n >> self.shrink

    @property
    def rate(self) -> float:
        return self.n ** (self.epsilon - 1)

    def subspace(self) -> np.ndarray:
        return uniform61(rng(self.seed, "subspace"), (self.n, self.n1))

    def row_blind(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, s = [], []
        for i in ids:
            g = rng(self.seed, "row", int(i))
            h.append(uniform61(g, self.n1))
            s.append(sparse_field(*sparse(g, self.n, self.rate), self.n))
        return (np.stack(h), np.stack(s)) if len(ids) else (np.zeros((0, self.n1), np.uint64), np.zeros((0, self.n), np.uint64))

    def _padded(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] > self.n:
            raise ValueError(f"{x.shape[1]} components do not fit {self.n}")
        return np.hstack([to_field(x), np.zeros((len(x), self.n - x.shape[1]), np.uint64)])

    def encrypt(self, ids: np.ndarray, x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(M + H L^T + S, M L)."""
        m = self._padded(x)
        h, s = self.row_blind(ids)
        used = x.shape[1]
        return add61(add61(m, matmul61(h, np.ascontiguousarray(base.T))), s), matmul61(m[:, :used], base[:used])

    def encode(self, q: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(v + L g + t, g, t) for each query."""
        v = self._padded(q)
        r = rng(self.seed, "query")
        g = uniform61(r, (len(q), self.n1))
        t = np.stack([sparse_field(*sparse(r, self.n, self.rate), self.n) for _ in q]) if len(q) else np.zeros((0, self.n), np.uint64)
        return add61(add61(v, matmul61(g, np.ascontiguousarray(base.T))), t), g, t

    def decode(self, ids: np.ndarray, x: np.ndarray, answer: np.ndarray, al: np.ndarray, query: tuple[np.ndarray, np.ndarray, np.ndarray], base: np.ndarray) -> np.ndarray:
        v, g, t = query
        h, s = self.row_blind(ids)
        own = add61(matmul61(al, np.ascontiguousarray(g.T)), matmul61(self._padded(x), np.ascontiguousarray(t.T)))
        mask = add61(matmul61(h, matmul61(np.ascontiguousarray(base.T), np.ascontiguousarray(v.T))), matmul61(s, np.ascontiguousarray(v.T)))
        return lift(sub61(sub61(answer, own), mask))

    @property
    def query_bytes(self) -> int:
        return self.n * 24

    def encoded(self, postings: DataFrame) -> DataFrame:
        """Adds ``m``, the blinded rows, and ``al``, the rows' images in the subspace, which the client keeps."""
        base = self.subspace()
        return _added(postings, lambda ids, x: self.encrypt(ids, x, base), "m", "al")

    def asking(self, q: np.ndarray) -> Asking:
        base = self.subspace()
        return BlindedQueries(self, self.encode(q, base), base)

    def verify(self, corpus: DataFrame, queries: DataFrame, tamper: int = 0, routes: DataFrame | None = None) -> DataFrame:
        """(qid, cid, trial, ok): random combinations of rows, of the matrix times the query and of the answer, must agree.

        Each batch sums its rows' part of both sides; only those sums are shuffled. ``tamper`` is added to the answers of vector 0. With routes(qid, cid)
        the clusters of postings are checked one by one, for the queries routed to them; else the corpus is one cluster, 0.
        """
        ship(corpus.sparkSession)
        base, out = self.subspace(), None
        cid = F.lit(0).cast("long") if routes is None else F.col("cid")
        postings = self.encoded(corpus.select(cid.alias("cid"), F.col("vec_id").cast("long"), "embedding"))
        for qids, q in query_blocks(queries, self.query_bytes):
            if routes is None:
                wanted = {0: np.arange(len(qids))}
            else:
                rows = routes.select("qid", "cid").join(queries.sparkSession.createDataFrame([(int(i),) for i in qids], "qid long"), "qid").toArrow()
                wanted = wanted_of(np.searchsorted(qids, rows.column("qid").to_numpy()), rows.column("cid").to_numpy())
            found = postings.mapInArrow(self._checks(qids, wanted, self.encode(q, base)[0], tamper), "qid long, cid long, trial long, l long, r long")
            out = found if out is None else out.unionByName(found)
        if out is None:
            return corpus.sparkSession.createDataFrame([], "qid long, cid long, trial long, ok boolean")
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")) % F.lit(P61).cast("decimal(38,0)")
        return out.groupBy("qid", "cid", "trial").agg((total("l") == total("r")).alias("ok"))

    def _checks(self, qids: np.ndarray, wanted: dict[int, np.ndarray], asked: np.ndarray, tamper: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in np.unique(batch.column("cid").to_numpy()).tolist():
                    at = wanted.get(c)
                    if at is None:
                        continue
                    part = batch.take(pa.array(np.flatnonzero(batch.column("cid").to_numpy() == c)))
                    ids, m, v = part.column("vec_id").to_numpy(), _held(part, "m"), np.ascontiguousarray(asked[at].T)
                    answer = matmul61(m, v)
                    answer[ids == 0] = reduce61(answer[ids == 0] + np.uint64(tamper))
                    w = np.stack([uniform61(rng(self.seed, "trial", int(i)), self.trials) for i in ids], 1)
                    left, right = matmul61(w, answer), matmul61(matmul61(w, m), v)
                    trial, place = np.meshgrid(np.arange(self.trials), np.arange(len(at)), indexing="ij")
                    columns = [qids[at[place.ravel()]], np.full(place.size, c), trial.ravel(), left.ravel().astype(np.int64), right.ravel().astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["qid", "cid", "trial", "l", "r"])

        return run


class BlindedQueries(Asking):
    def __init__(self, scheme: Blinded, query: tuple[np.ndarray, np.ndarray, np.ndarray], base: np.ndarray) -> None:
        self.scheme, self.query, self.base = scheme, query, base

    @property
    def steps(self) -> tuple:
        return ("server-compute", lambda part, at, _: matmul61(_held(part, "m"), np.ascontiguousarray(self.query[0][at].T))), ("decode", self._decode)

    def _decode(self, part: pa.RecordBatch, at: np.ndarray, answer: np.ndarray) -> np.ndarray:
        own = tuple(x[at] for x in self.query)
        return self.scheme.decode(part.column("vec_id").to_numpy(), matrix(part.column("embedding")), answer, _held(part, "al"), own, self.base)


def require_verified(checks: DataFrame) -> None:
    bad = checks.where("NOT ok").select("qid", "trial").first()
    if bad:
        raise ValueError(f"query {bad['qid']} fails verification in trial {bad['trial']}")


# Linear retrieval


@dataclass(frozen=True)
class Retrieval:
    """Codes of ``bits`` bits modulo p, secrets of n entries, noise of deviation sigma; arithmetic is modulo 2^64."""

    bits: int = 4
    p: int = 1 << 15
    n: int = 2048
    sigma: float = 81920.0
    seed: int = 42

    name, value, ascending, held = "tiptoe", "long", False, "hint"

    @property
    def delta(self) -> int:
        return (1 << 64) // self.p

    def codes(self, x: np.ndarray) -> np.ndarray:
        mag = (1 << self.bits) - 1
        v = (np.asarray(x, np.float32) * np.float32(mag)).astype(np.float64)
        return np.mod(np.clip(np.copysign(np.floor(np.abs(v) + 0.5), v), -mag, mag).astype(np.int64), self.p).astype(np.uint64)

    def public(self, dim: int) -> np.ndarray:
        return rng(self.seed, "public").integers(0, 1 << 64, (dim, self.n), dtype=np.uint64)

    def encrypt(self, q: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ciphertexts, secrets): A s + e + delta q for each query."""
        g = rng(self.seed, "secret")
        s = g.integers(0, 3, (len(q), self.n)).astype(np.uint64)
        e = np.rint(g.normal(0, self.sigma, q.shape)).astype(np.int64).astype(np.uint64)
        return s @ a.T + e + np.uint64(self.delta) * q, s

    def recover(self, answer: np.ndarray, hint_s: np.ndarray) -> np.ndarray:
        """Signed products from the server's answers and hint times secret."""
        z = ((answer - hint_s + np.uint64(self.delta // 2)) // np.uint64(self.delta)) % np.uint64(self.p)
        z = z.astype(np.int64)
        return np.where(z > self.p // 2, z - self.p, z)

    @property
    def query_bytes(self) -> int:
        return self.n * 8

    def encoded(self, postings: DataFrame) -> DataFrame:
        """Adds ``codes``, the quantised rows, and ``hint``, their products with the public matrix."""
        dim = postings.select(F.max(F.size("embedding"))).first()[0] or 0
        a = self.public(dim)

        def encode(_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            codes = self.codes(x)
            return codes, codes @ a

        return _added(postings, encode, "codes", "hint")

    def asking(self, q: np.ndarray) -> Asking:
        return RetrievalQueries(self, *self.encrypt(self.codes(q), self.public(q.shape[1])))


class RetrievalQueries(Asking):
    """Ciphertexts and secrets. The server's part of the hint times the secret goes through limbs, as its compression does."""

    def __init__(self, scheme: Retrieval, ciphertexts: np.ndarray, secrets: np.ndarray) -> None:
        self.scheme, self.ciphertexts, self.secrets = scheme, ciphertexts, secrets

    @property
    def steps(self) -> tuple:
        return (
            ("server-compute", lambda part, at, _: _held(part, "codes") @ self.ciphertexts[at].T),
            ("decompress", lambda part, at, answer: (answer, hint_times_secrets(_held(part, "hint"), self.secrets[at]))),
            ("decode", lambda part, at, both: self.scheme.recover(*both)),
        )


#: Ring size, plaintext modulus and ciphertext modulus bits under which hints are compressed, and bits of a limb.
RING, PLAIN, CIPHER_BITS, LIMB = 2048, 65537, 38, 4


def check_ring(entries: int, largest_secret: int = 2) -> None:
    """Refuses parameters under which a limb's product with a secret would wrap in the plaintext ring."""
    if entries > RING or ((1 << LIMB) - 1) * largest_secret * entries >= PLAIN:
        raise ValueError(f"{entries} entries do not fit a ring of {RING} with plaintexts modulo {PLAIN}")


def hint_limbs(hint: np.ndarray) -> np.ndarray:
    """(limbs, rows, entries) of unsigned 64-bit integers, least first."""
    return np.stack([(hint >> np.uint64(i)) & np.uint64((1 << LIMB) - 1) for i in range(0, 64, LIMB)])


def hint_times_secrets(hint: np.ndarray, secrets: np.ndarray) -> np.ndarray:
    """(rows x queries) modulo 2^64 from products of limbs, each within the plaintext ring: the clear arithmetic of hint compression, without encryption."""
    check_ring(hint.shape[1])
    out = np.zeros((len(hint), len(secrets)), np.uint64)
    s = secrets.astype(np.float32).T  # products of limbs stay under 2^16, so single precision is exact
    for i, part in enumerate(hint_limbs(hint)):
        out += (part.astype(np.float32) @ s).astype(np.uint64) << np.uint64(LIMB * i)
    return out


def augmented_query(codes: np.ndarray, place: int, clusters: int) -> np.ndarray:
    """A query for the layout in which each cluster has columns of its own: zero but for those of the one cluster that is asked."""
    out = np.zeros(len(codes) * clusters, codes.dtype)
    out[place * len(codes) : (place + 1) * len(codes)] = codes
    return out


def limbs(v: Column, n: int = 16, width: int = 4) -> Column:
    """Limbs of an integer's 64 bits, least first: the clear arithmetic of hint compression, without encryption. Fewer limbs than 64 bits need hold its low bits only."""
    return F.array(*[limb(v, i, width) for i in range(n)])


def from_limbs(parts: Column, width: int = 4) -> Column:
    """The integer whose limbs these are, of either sign."""
    return F.aggregate(F.reverse(parts), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, width).bitwiseOR(x))


__all__ = ["Asking", "Blinded", "Retrieval", "ScaleKey", "Scheme", "Trapdoor", "mul61", "require_verified", "scale_encrypt", "scale_keygen", "top"]
