"""Near-duplicate documents by MinHash bands, sequential Bayesian pruning and exact verification.

1. One pass over the texts gives each document the size and a digest of its shingle set, a signature of one
   byte for each of :data:`HASHES` permutations, and :data:`BANDS` band keys of :data:`ROWS` permutations each. A pair at similarity
   0.8 shares no band with probability (1 - 0.8**4)**24, three in a million.
2. Equal sets collapse to one representative. Everything below works on representatives.
3. Candidates of a band key compare signatures batch by batch. With m of h bytes equal, the posterior
   probability that similarity reaches the threshold is P(Binomial(h + 1, threshold) <= m) under a uniform prior; a pair
   is pruned once that falls under its part of :data:`MISS`. Only a spanning forest of the survivors is kept. The members of a
   key with more than :data:`SMALL` are tied to its first for now; their pairs are compared in the next steps.
4. The connected components of these edges are clusters: every candidate pair that survives lies within one. Clusters are dealt into blocks
   of about :data:`BLOCK` documents with their full shingle sets, and some hub documents are in every block of their cluster: those whose signatures
   agree most with the cluster's most frequent bytes, as the original of many copies does, and some by a draw. A block compares
   all its pairs that are not connected yet, prunes by the same rule, and verifies survivors exactly on full sets.
5. A cluster of several blocks is split by second keys: each document's rarest shingles, so many that two linked documents must share
   one (all but 80 of 100, and one more; the order of rarity is the same for all). Documents outside the largest component of their cluster give all
   their keys; those within, whose pairs are connected, only keys that a bitmap of the others' allows. Keys whose documents are connected
   already are done. The pairs of each other key are pruned without full sets: by how much they can share at most after the places of their first
   common key, and by signatures. So pages that share a template and no more never meet. The components of the pairs that are left are finer
   clusters, and step 4 goes over these once more; what a finer cluster of several blocks then still has outside its largest component
   meets all of its blocks.
6. Components of the verified links are the result.

No step emits the pairs of a group: blocks emit spanning forests, which lose no component. No key, bucket
or cluster is capped.

Defined cases. A null or empty text, or one of white space only, has an empty set and is linked with nothing.
Fewer words than a shingle count as one shingle of all words. Ties go to the smallest doc_id. Rows that repeat a
doc_id are one document, linked with what either is linked with. A row with a null doc_id is linked with
nothing, has a null component and is kept. An empty table gives an empty result. Other columns are not read. :func:`keep_one` takes
each row as a document of its own, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.bitmap import anti_join, bitmap, candidates
from nearfield.llm.components import components
from nearfield.llm.shingles import MinHash, mix64, set_digests, shingle_hashes
from nearfield.runs import complete_runs, trimmed
from nearfield.session import discard, materialise, ship
from nearfield.tables import fresh, lookup

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Members up to which a band key's pairs are compared at once.
SMALL = 64
#: Signature bytes compared before each look, and the chance of losing a pair at the threshold over all looks.
LOOK, MISS = 16, 1e-5
#: Documents in a block, and hub documents of each kind that the blocks of a large cluster share, about.
BLOCK, HUBS = 128, 8
#: Documents of a second key whose pairs one task compares by signatures.
WIDE = 1024
#: Buckets of the counts that say how rare a shingle is. Any order is a right one; a bounded table of counts makes it a good one.
BUCKETS = 1 << 20
#: Bits of the bitmap of keys that documents outside their cluster's largest component have.
OPEN_BITS = 1 << 26
#: Rows of an Arrow batch where rows hold texts or sets.
ARROW_ROWS = 1000


@lru_cache
def least_matches(threshold: float) -> tuple[tuple[int, int], ...]:
    """(h, m): after h bytes a pair with fewer than m equal is pruned."""
    looks = range(LOOK, HASHES + 1, LOOK)
    out = []
    for h in looks:
        tail, m = 0.0, 0
        while m <= h:
            tail += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if tail >= MISS / len(looks):
                break
            m += 1
        out.append((h, m))
    return tuple(out)


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (a[i], b[i]) that no look prunes, and their matches."""
    at = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    done = 0
    for h, least in least_matches(threshold):
        matches += (sig[a[at], done:h] == sig[b[at], done:h]).sum(1, dtype=np.int32)
        keep = matches >= least
        at, matches, done = at[keep], matches[keep], h
    return at, matches


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _profile(k: int):
    minhash = MinHash(HASHES)
    salts = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = list(shingle_hashes(b.column(1).to_pylist(), k))
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n > 0)
                sig = minhash.signatures([sets[i] for i in full]) if len(full) else np.zeros((0, HASHES), np.uint32)
                rows = sig.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                keys = np.broadcast_to(salts, (len(full), BANDS))
                for j in range(ROWS):
                    keys = mix64(keys ^ rows[:, :, j])
                digest = set_digests(sets)
                of = dict(zip(full.tolist(), range(len(full)), strict=True))
                small = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(n),
                        pa.array(digest[:, 0].view(np.int64)),
                        pa.array(digest[:, 1].view(np.int64)),
                        pa.array([small[of[i]].tobytes() if i in of else None for i in range(len(sets))], pa.binary()),
                        pa.array([keys[of[i]].view(np.int64) if i in of else None for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"],
                )

    return run


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _band_edges(threshold: float):
    """Spanning forests of the surviving pairs of whole band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_runs(batches, ["band"]):
            ids, sig = t.column("doc_id").to_numpy(), _signatures(t.column("sig"))
            sizes = np.diff(np.append(starts, t.num_rows))
            nodes, node = np.unique(ids, return_inverse=True)
            forest = Forest(len(nodes))
            found = []
            for s in np.unique(sizes[sizes > 1]):
                i, j = np.triu_indices(s, 1)
                own = starts[sizes == s]
                for part in (own[x : x + max(1, 100_000 // len(i))] for x in range(0, len(own), max(1, 100_000 // len(i)))):
                    a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                    at, _ = surviving(sig, a, b, threshold)
                    found += [(ids[x], ids[y]) for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True) if forest.join(node[x], node[y])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = [s.tobytes() for s in shingle_hashes(b.column(b.schema.get_field_index("text")).to_pylist(), k)]
                i = b.schema.get_field_index("text")
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(b.num_columns) if c != i), pa.array(sets, pa.binary())], [*(n for n in b.schema.names if n != "text"), "members"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _block_edges(percent: int):
    """Verified links of each block, as a spanning forest. Blocks with two sides compare one with the other only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_runs(batches, ["cluster", "block", "part"]):
            ids, sig = t.column("doc_id").to_numpy(), _signatures(t.column("sig"))
            labels, side = t.column("component").to_numpy(), t.column("side").to_numpy()
            members = t.column("members")
            found = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                own = ids[s:e]
                sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in members.slice(s, e - s)]
                n = np.array([len(x) for x in sets])
                _, label = np.unique(labels[s:e], return_inverse=True)
                forest = Forest(len(label))  # over labels: what is connected already is one node
                for a, b in _pairs(e - s, side[s:e]):
                    a, b, matches = _possible(sig[s:e], n, label, a, b, percent)
                    for i in np.argsort(-matches, kind="stable").tolist():
                        x, y = label[a[i]], label[b[i]]
                        if forest.find(x) != forest.find(y) and linked(sets[a[i]], sets[b[i]], percent):
                            forest.join(x, y)
                            found.append((own[a[i]], own[b[i]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _possible(sig: np.ndarray, n: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (a, b), and their matches, whose sizes and signatures allow a link between different components."""
    keep = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (label[a] != label[b])
    a, b = a[keep], b[keep]
    at, matches = surviving(sig, a, b, percent / 100)
    return a[at], b[at], matches


_PLACE = ["cluster", "block", "part", "doc_id", "component", "side"]


def _plausible(percent: int):
    """Spanning forests of the pairs of each second key that neither places, sizes nor signatures rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_runs(batches, ["cluster", "block", "part"]):
            ids, sig, side = t.column("doc_id").to_numpy(), _signatures(t.column("sig")), t.column("side").to_numpy()
            n, left, labels = (t.column(c).to_numpy() for c in ("n_shingles", "left", "component"))
            found = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                forest = Forest(e - s)
                for a, b in _pairs(e - s, side[s:e]):
                    # From the first key that both have, they share no more than what either has left; 100 * shared >= percent * union.
                    shared = np.minimum(left[s + a], left[s + b])
                    keep = (100 + percent) * shared >= percent * (n[s + a] + n[s + b])
                    a, b, _ = _possible(sig[s:e], n[s:e], labels[s:e], a[keep], b[keep], percent)
                    found += [(ids[s + x], ids[s + y]) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, cell, n): how often each byte stands at each place of the signatures of a batch's clusters; cell is place * 256 + byte."""
    for b in batches:
        cluster, cells = b.column("cluster").to_numpy(), _signatures(b.column("sig")).astype(np.int64) + np.arange(HASHES) * 256
        for c in np.unique(cluster):
            cell, n = np.unique(cells[cluster == c], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), c)), pa.array(cell), pa.array(n)], ["cluster", "cell", "n"])


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        usual = np.array(b.column("usual").to_pylist(), np.int64).reshape(b.num_rows, HASHES)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("cluster"), pa.array((_signatures(b.column("sig")) == usual).sum(1))], ["doc_id", "cluster", "agree"])


def _hubs(pool: DataFrame) -> DataFrame:
    """(doc_id): of each cluster of several blocks the documents nearest its usual signature, and some by a draw. pool is (doc_id, cluster, size, sig)."""
    counts = pool.select("cluster", "sig").mapInArrow(trimmed(_byte_counts), "cluster long, cell long, n long").groupBy("cluster", "cell").agg(F.sum("n").alias("n"))
    place = F.floor(F.col("cell") / 256)
    usual = counts.groupBy("cluster", place.alias("place")).agg(F.max_by(F.col("cell") % 256, F.struct("n", "cell")).alias("byte"))
    usual = materialise(usual.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "byte"))), lambda x: x["byte"]).alias("usual")), "near-usual")
    agree = lookup(pool.select("doc_id", "cluster", "sig"), "cluster", usual, "doc_id").mapInArrow(trimmed(_agreements), "doc_id long, cluster long, agree long")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("agree"), "doc_id"))
    central = agree.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("doc_id")
    drawn = pool.where(_share(2) < F.lit(float(HUBS)) / F.col("size")).select("doc_id")
    return materialise(central.unionByName(drawn).distinct(), "near-hubs")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            counts += np.bincount(_bucket(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["bucket", "n"])


def _rare_keys(percent: int, counts, asked=None):
    """(key, doc_id, component, left): a key for each of the rarest shingles of a document within its cluster; only those that ``asked`` may have, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for b in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                keys, left = [], []
                for cluster, m in zip(b.column("cluster").to_numpy(), b.column("members"), strict=True):
                    x = np.frombuffer(m.as_buffer(), np.uint64)
                    p = len(x) - -(-percent * len(x) // 100) + 1
                    rare = np.lexsort((x, often[_bucket(x)]))[:p]
                    rest = len(x) - np.arange(p)  # shingles from the key on, itself included
                    key = mix64(x[rare] ^ mix64(np.array([cluster], np.int64).view(np.uint64)))
                    if asked is not None:
                        at = key % np.uint64(OPEN_BITS)
                        here = (asked.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                        key, rest = key[here], rest[here]
                    keys.append(key)
                    left.append(rest)
                at = np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
                key = pa.array(np.concatenate(keys).view(np.int64)) if keys else pa.array([], pa.int64())
                rest = pa.array(np.concatenate(left), pa.int64()) if left else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([key, b.column("doc_id").take(pa.array(at)), b.column("component").take(pa.array(at)), rest], ["key", "doc_id", "component", "left"])

    return run


def _key_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bits) of a bitmap of a partition's keys."""
    words = np.zeros(OPEN_BITS >> 6, np.uint64)
    for b in batches:
        at = b.column(0).to_numpy().view(np.uint64) % np.uint64(OPEN_BITS)
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    used = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used].view(np.int64))], ["word", "bits"])


def _pairs(m: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block, some rows of it at a time: all, or those of the two sides if it has two."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    step = max(1, 200_000 // max(1, m))
    for i in range(0, len(left), step):
        own = left[i : i + step]
        if len(right):
            yield np.repeat(own, len(right)), np.tile(right, len(own))
        else:
            a, b = np.repeat(own, m), np.tile(np.arange(m), len(own))
            yield a[a < b], b[a < b]


def _share(salt: int):
    """A uniform draw in [0, 1) from a document's id."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(salt)), 11) / F.lit(float(1 << 53))


def _by_block(rows: DataFrame, run, schema: str, *also: str) -> DataFrame:
    """``run`` over whole blocks; also: columns besides those of the place."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*_PLACE, "sig", *also).repartition(n, "cluster", "block", "part").sortWithinPartitions("cluster", "block", "part")
    return dealt.mapInArrow(trimmed(run), schema)


def _verified(rows: DataFrame, percent: int, name: str) -> DataFrame:
    return materialise(_by_block(rows, _block_edges(percent), "a long, b long", "members"), name, ARROW_ROWS)


_every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _in_blocks(pool: DataFrame, percent: int, name: str) -> DataFrame:
    """Links of step 4. pool is (doc_id, cluster, size, component, sig, members)."""
    blocks = F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("long")
    rows = pool.withColumn("blocks", blocks).withColumn("block", F.floor(_share(1) * F.col("blocks")).cast("long")).withColumn("part", F.lit(0).cast("long")).withColumn("side", F.lit(0))
    large = rows.where("blocks > 1")
    if large.limit(1).count():
        hubs = _hubs(large.select("doc_id", "cluster", "size", "sig"))
        own = rows.join(hubs, "doc_id", "left_anti")
        # Hubs are few of each cluster; each is in all blocks.
        everywhere = large.join(hubs, "doc_id").withColumn("block", _every("blocks"))
        rows = own.unionByName(everywhere)
    return _verified(rows, percent, name)


def _sized(placed: DataFrame) -> DataFrame:
    sizes = materialise(placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    return lookup(placed, "cluster", sizes, "doc_id")


def _open_parts(placed: DataFrame) -> DataFrame:
    """placed(cluster, doc_id, component, ...) of clusters with several components, with ``size``, the ``largest`` component, and the rows in others, ``open``."""
    counts = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("largest"), (F.sum("n") - F.max("n")).alias("open"))
    whole = materialise(whole.where("kinds > 1").drop("kinds"), "near-mixed")
    return lookup(materialise(candidates(placed, "cluster", bitmap(whole, "cluster")), "near-parted"), "cluster", whole, "doc_id")


def _crossing(rows: DataFrame, width: int, salt: int) -> DataFrame:
    """Rows of :func:`_open_parts` dealt so that each pair of different components meets once: whole where ``width`` documents suffice; else rows outside
    the largest component go to every block."""
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / F.lit(float(width))).cast("long")).withColumn("parts", F.ceil(F.col("open") / F.lit(float(width))).cast("long"))
    zero = F.lit(0).cast("long")
    one = rows.where("blocks = 1").withColumn("block", zero).withColumn("part", zero).withColumn("side", F.lit(0))
    several = rows.where("blocks > 1")
    fixed = several.withColumn("block", F.floor(_share(salt) * F.col("blocks")).cast("long")).withColumn("part", _every("parts")).withColumn("side", F.lit(0))
    roaming = several.where("component <> largest").withColumn("block", _every("blocks")).withColumn("part", F.floor(_share(salt + 1) * F.col("parts")).cast("long")).withColumn("side", F.lit(1))
    return one.unionByName(fixed).unionByName(roaming)


def _components_so_far(large: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """large with each document's component by the links found."""
    so_far = components(links, name).withColumnRenamed("node", "doc_id")
    return large.join(so_far, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _second_keys(pool: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links, with those between the components so far of clusters of several blocks, by step 5."""
    spark = pool.sparkSession
    large = pool.where(F.col("size") > BLOCK)
    counted = materialise(large.select("members").mapInArrow(trimmed(_bucket_counts), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "near-counts")
    often = np.zeros(BUCKETS, np.int64)
    for b in counted.toArrow().to_batches():  # at most BUCKETS rows
        often[b.column(0).to_numpy()] = b.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(often)
    places = materialise(_components_so_far(large.select("doc_id", "cluster"), links, "near-first"), "near-places")
    # Clusters of one component are done.
    parts = _open_parts(places).select("doc_id", "cluster", "component", "largest")
    known = materialise(parts.join(large.select("doc_id", "members"), "doc_id"), "near-known", ARROW_ROWS)
    schema = "key long, doc_id long, component long, left long"
    apart = materialise(known.where("component <> largest").mapInArrow(trimmed(_rare_keys(percent, shared)), schema), "near-apart", ARROW_ROWS)
    bits = materialise(apart.select("key").mapInArrow(trimmed(_key_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")), "near-bits")
    words = np.zeros(OPEN_BITS >> 6, np.uint64)
    for b in bits.toArrow().to_batches():  # at most OPEN_BITS / 64 rows
        words[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    asked = spark.sparkContext.broadcast(words)
    main = materialise(known.where("component = largest").mapInArrow(trimmed(_rare_keys(percent, shared, asked)), schema), "near-main", ARROW_ROWS)
    met = materialise(_open_parts(apart.unionByName(main).withColumnRenamed("key", "cluster")), "near-keyed")
    signed = _crossing(met, WIDE, 3).join(large.select("doc_id", "sig", F.expr("length(members) div 8").alias("n_shingles")), "doc_id")
    finer = materialise(_by_block(signed, _plausible(percent), "a long, b long", "n_shingles", "left"), "near-plausible", ARROW_ROWS)
    for held in (shared, asked):  # what they gave is written, so no task reads them again
        held.destroy()
    discard(known, apart, main, met)
    if not finer.limit(1).count():
        return links
    finer = _sized(components(finer, "near-finer").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))
    finer = materialise(finer.join(places.select("doc_id", "component"), "doc_id").join(large.select("doc_id", "sig", "members"), "doc_id"), "near-finer", ARROW_ROWS)
    links = links.unionByName(_in_blocks(finer, percent, "near-again"))
    several = finer.where(F.col("size") > BLOCK)
    if several.limit(1).count():
        left = _crossing(_open_parts(materialise(_components_so_far(several.select("doc_id", "cluster"), links, "near-second"), "near-left")), BLOCK, 5)
        links = links.unionByName(_verified(left.join(several.select("doc_id", "sig", "members"), "doc_id"), percent, "near-more"))
    return links


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs; doc_id is an integer."""
    spark = docs.sparkSession
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = materialise(texts.mapInArrow(trimmed(_profile(words)), "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"), "near-profile", ARROW_ROWS)
    sets = ["set_a", "set_b", "n_shingles"]
    classes = materialise(profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(F.min("doc_id").alias("doc_id")), "near-classes")
    reps = materialise(profile.select("doc_id", "n_shingles", "sig", "bands").join(classes.select("doc_id").distinct(), "doc_id", "left_semi"), "near-reps")

    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    keys = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    members = materialise(banded.join(keys, "band"), "near-members")
    signed = members.where(f"n <= {SMALL}").select("band", "doc_id").join(reps.select("doc_id", "sig"), "doc_id")
    forests = signed.select("band", "doc_id", "sig").repartition(partitions, "band").sortWithinPartitions("band").mapInArrow(trimmed(_band_edges(percent / 100)), "a long, b long")
    # A document in several large keys hangs on one of their centres; that the centres belong together is said once, not by each document.
    hung = members.where(f"n > {SMALL}").groupBy("doc_id").agg(F.sort_array(F.collect_set("first")).alias("centres"))
    spokes = hung.select(F.col("centres")[0].alias("a"), F.col("doc_id").alias("b"))
    rims = hung.select(F.col("centres")[0].alias("a"), F.explode("centres").alias("b")).distinct()
    stars = spokes.unionByName(rims).where("a <> b")
    clusters = components(forests.unionByName(stars), "near-clusters").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster")

    dealt = _sized(clusters).join(reps.select("doc_id", "sig"), "doc_id")
    # Texts whose id is in no cluster do not take part in the shuffle.
    wanted = candidates(texts, "doc_id", bitmap(clusters, "doc_id"))
    pool = materialise(dealt.join(wanted, "doc_id").mapInArrow(trimmed(_sets(words)), "doc_id long, cluster long, size long, sig binary, members binary"), "near-pool", ARROW_ROWS)
    # Each document is alone at first: its id is its component.
    links = _in_blocks(pool.withColumn("component", F.col("doc_id")), percent, "near-links")
    if pool.where(F.col("size") > BLOCK).limit(1).count():
        links = _second_keys(pool, links, percent)

    found = components(links, "near-found").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "component_id")
    of_class = materialise(classes.join(found, "doc_id", "left").select(*sets, F.coalesce("component_id", "doc_id").alias("component_id")), "near-classes")
    out = profile.select("doc_id", *sets).join(of_class, sets, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    discard(members, pool)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without all but one row of each component: that with the smallest id, nulls last.

    Rows are numbered once, in a table, and the numbers stand for documents: rows that repeat an id or have none are documents of their own.
    """
    (row,) = fresh(docs, "_row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-numbered")
    found = materialise(near_components(numbered, words, percent, row, text_col).select(F.col("doc_id").alias("row"), "component_id"), "near-rows")
    groups = materialise(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id"), "near-groups")
    placed = lookup(materialise(candidates(found, "component_id", bitmap(groups, "component_id")), "near-grouped"), "component_id", groups, "row")
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
    placed = materialise(placed.join(candidates(ids, "row", bitmap(placed, "row")), "row").select("component_id", "row", "id"), "near-placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("stays"))
    gone = lookup(placed, "component_id", first, "row").where("row <> stays").select(F.col("row").alias(row))
    return anti_join(numbered, gone, row).drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
