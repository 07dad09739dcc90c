"""Sets of word shingles as 64-bit hashes, and their MinHash signatures, in NumPy over whole batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240117)
#: A random code for each byte; capital and small A-Z share theirs.
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_white = re.compile(rb"[\x20\x09-\x0d]").search
_BASE = np.uint64(int(_rng.integers(1 << 62, 1 << 63)) | 1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SET_SALTS = _rng.integers(1, 1 << 63, 2, dtype=np.uint64)
#: Text that is hashed at once; arrays of eight bytes for each of its bytes exist meanwhile.
PART_BYTES = 300_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of UTF-8 text: A-Z as a-z, words parted by white space. Very long texts are read in parts that end at white space."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = at + 4 * PART_BYTES
        if to < len(data):
            cut = _white(data, to)
            to = cut.start() if cut else len(data)
        h, s = _word_hashes(data[at:to] if at or to < len(data) else data)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (hashes[0], starts[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(starts))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_SPACE[b])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    return mix64(np.add.reduceat(_CODE[b[at]] * power[place], first) + length.astype(np.uint64)), at[first]


def shingle_hashes(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of all its words if there are fewer."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1]) + 1
        if size >= PART_BYTES:
            yield from _of_part(part, k)
            part, size = [], 0
    yield from _of_part(part, k)


def _of_part(part: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not part:
        return
    words, starts = word_hashes(b"\n".join(part))
    ends = np.cumsum([len(x) + 1 for x in part])
    bounds = np.searchsorted(starts, np.append(0, ends))
    n = max(0, len(words) - k + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += words[j : j + n] * _PLACE[j]
    grams = mix64(grams)
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if z - a >= k:
            yield np.unique(grams[a : z - k + 1])
        elif z > a:
            yield mix64(np.array([(words[a:z] * _PLACE[: z - a]).sum(dtype=np.uint64) + np.uint64(z - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums for each set, equal for equal sets."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        for j in range(2):
            out[i, j] = mix64(s ^ _SET_SALTS[j]).sum(dtype=np.uint64)
    return out


class MinHash:
    """Signatures of ``n`` permutations x -> a x + b over the upper half of a shingle's hash."""

    def __init__(self, n: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set; no set may be empty."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        at = 0
        while at < len(sets):
            z, size = at, 0
            while z < len(sets) and (z == at or size + len(sets[z]) <= 100_000):
                size += len(sets[z])
                z += 1
            x = (np.concatenate(sets[at:z]) >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0, *(len(s) for s in sets[at : z - 1])])
            t = np.empty_like(x)
            for j in range(len(self.a)):
                np.multiply(x, self.a[j], out=t)
                t += self.b[j]
                out[at:z, j] = np.minimum.reduceat(t, starts)
            at = z
        return out
