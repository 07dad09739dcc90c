"""Connected components of an edge table: contraction of chunks of edges, then smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import discard, materialise, ship
from nearfield.tables import lookup

#: Edges that a task contracts at once, and of one node that one task reads, about.
CHUNK, EDGES = 250_000, 50_000


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches) over the edges a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        best = np.minimum(label[u], label[v])
        after = label.copy()
        for side in (u, v, label[u], label[v]):  # the labels' own nodes too, so that whole components hook on
            np.minimum.at(after, side, best)
        after = after[after]
        if np.array_equal(after, label):
            return nodes, nodes[label]
        label = after


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of each chunk of edges by itself."""
    a, b, n = [], [], 0

    def out() -> pa.RecordBatch:
        nodes, labels = smallest_labels(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "component"])

    for batch in batches:
        for s in range(0, batch.num_rows, CHUNK):
            part = batch.slice(s, CHUNK)
            if n and n + part.num_rows > CHUNK:
                yield out()
                a, b, n = [], [], 0
            a.append(part.column(0).to_numpy())
            b.append(part.column(1).to_numpy())
            n += part.num_rows
    if n:
        yield out()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) from (a, b): component is the smallest node reachable. Nodes without an edge have no row.

    The edges are written once, as tasks that emit spanning forests may emit other ones when they run again. Chunks of at most :data:`CHUNK` edges are
    contracted to stars where they lie, which shortens all paths; with one chunk that is the result. The stars of several are joined by rounds of
    a join, a partial minimum and a jump to the label's label, so rounds grow with the logarithm of the longest path that is left. Edges and labels stay distributed.

    A centre of many edges is dealt over as many shares as its edges need, and its label goes to each; the nodes of a large component look its label's
    label up in many tasks.
    """
    ship(edges.sparkSession)
    given = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).where("node <> near"), f"{name}-given")
    chunks = max(1, -(-given.count() // CHUNK))
    stars = materialise(given.coalesce(chunks).mapInArrow(_contract, "node long, component long"), f"{name}-stars")
    discard(given)
    return stars if chunks == 1 else _joined(stars.where("node <> component").withColumnRenamed("component", "near"), name)


def _joined(given: DataFrame, name: str) -> DataFrame:
    both = given.unionByName(given.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct()
    both = materialise(both.withColumn("share", F.lit(0)), f"{name}-edges")
    hot = materialise(both.groupBy("near").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > EDGES).select("near", F.ceil(F.col("n") / EDGES).cast("int").alias("shares")), f"{name}-hot")
    if hot.limit(1).count():
        dealt = F.pmod(F.xxhash64("node"), F.coalesce("shares", F.lit(1))).cast("int")
        both = materialise(lookup(both.drop("share"), "near", hot, "node", "left").select("node", "near", dealt.alias("share")), f"{name}-edges")
    labels = materialise(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")), f"{name}-labels")
    while True:
        offers = labels.select(F.col("node").alias("near"), F.col("component").alias("offer")).join(hot, "near", "left")
        offers = offers.select("near", "offer", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
        seen = both.join(offers, ["near", "share"]).groupBy("node").agg(F.min("offer").alias("offer"))
        best = materialise(labels.join(seen, "node").select("node", F.col("component").alias("before"), F.least("component", "offer").alias("component")), f"{name}-best")
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = F.least("component", "further") < F.col("before")
        after = materialise(lookup(best, "component", jump, "node").select("node", F.least("component", "further").alias("component"), moved.alias("moved")), f"{name}-labels")
        discard(labels, best)
        labels = after
        if labels.where("moved").limit(1).count() == 0:
            return labels.drop("moved")
