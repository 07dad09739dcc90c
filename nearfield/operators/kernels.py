"""Exact NumPy kernels: distances with stable ties, and modular arithmetic over 2^61 - 1 and 2^64."""

from __future__ import annotations

import hashlib

import numpy as np

P61 = (1 << 61) - 1
_P = np.uint64(P61)
_LOW31 = np.uint64((1 << 31) - 1)
_LOW30 = np.uint64((1 << 30) - 1)


def rng(seed: bytes | int | str, *tags) -> np.random.Generator:
    """A generator for a seed and tags, equal wherever it is made."""
    key = hashlib.sha256(repr((seed, *tags)).encode()).digest()
    return np.random.default_rng(int.from_bytes(key[:16], "little"))


def reduce61(x: np.ndarray) -> np.ndarray:
    """x mod 2^61 - 1 for any unsigned 64-bit x."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def add61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce61(a + b)


def sub61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce61(a + (_P - b))


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod 2^61 - 1 of elements under it, by halves of 31 and 30 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1  # under 2^62
    # 2^62 = 2 and middle * 2^31 = (middle >> 30) + (middle & low 30) * 2^31, modulo 2^61 - 1
    return reduce61(reduce61(reduce61(np.uint64(2) * (a1 * b1)) + reduce61((middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)))) + reduce61(a0 * b0))


def sum61(x: np.ndarray, axis: int) -> np.ndarray:
    """A sum of elements mod 2^61 - 1: eight at a time cannot overflow."""
    x = np.moveaxis(x, axis, 0)
    while x.shape[0] > 1:
        n = -(-x.shape[0] // 7)
        x = np.concatenate([x, np.zeros((n * 7 - x.shape[0], *x.shape[1:]), np.uint64)]).reshape(n, 7, *x.shape[1:]).sum(1, dtype=np.uint64)
        x = reduce61(x)
    return x[0] if x.shape[0] else np.zeros(x.shape[1:], np.uint64)


def matmul61(a: np.ndarray, b: np.ndarray, rows: int = 256) -> np.ndarray:
    """a @ b mod 2^61 - 1, some rows at a time."""
    out = np.empty((a.shape[0], b.shape[1]), np.uint64)
    step = max(1, rows * 1024 // max(1, b.size))
    for i in range(0, a.shape[0], step):
        out[i : i + step] = sum61(mul61(a[i : i + step, :, None], b[None]), 1)
    return out


def to_field(x: np.ndarray, q: int = 1 << 20) -> np.ndarray:
    """Components as field elements, rounded half away from zero."""
    v = np.asarray(x, np.float64) * q
    return np.mod(np.copysign(np.floor(np.abs(v) + 0.5), v).astype(np.int64), P61).astype(np.uint64)


def lift(x: np.ndarray) -> np.ndarray:
    """Representatives around zero."""
    x = x.astype(np.int64)
    return np.where(x > P61 // 2, x - P61, x)


def uniform61(g: np.random.Generator, shape) -> np.ndarray:
    return g.integers(0, P61, shape, dtype=np.uint64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows by way of inner products."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None])


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first nearest row of c for each row of x. Near ties of the fast form are measured again by differences."""
    fast = squared(x, c)
    best = fast.min(1)
    close = fast <= (best + 1e-9 * (1 + best))[:, None]
    out = fast.argmin(1)
    for i in np.flatnonzero(close.sum(1) > 1):
        at = np.flatnonzero(close[i])
        out[i] = at[((c[at] - x[i]) ** 2).sum(1).argmin()]
    return out
