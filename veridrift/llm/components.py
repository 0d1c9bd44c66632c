"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Edges (16 bytes each) up to which no round is shuffled: they fit one batch of a task.
FEW_EDGES = 1 << 18


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a few edges the stars that they make: each node linked to the least that it reaches."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        nodes, root = least_reached(*(np.concatenate(c) for c in zip(*parts)))
        yield pa.record_batch([pa.array(c[nodes != root]) for c in (nodes, root)], names=["u", "v"])


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """Each node's neighbours (itself included) linked to the least of them; hubs are aggregated before the shuffle."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges u > v: each node's smaller neighbours, and itself, linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` (long) for each node of the edges ``u, v``; the root is the least node reached.

    Every round is written to the shared folder, so neither the lineage nor the work lost with
    an executor grows; the driver sees a count and a checksum only. A round is some seven shuffles, all of whose
    tasks the driver keeps account of, however few the edges; up to ``FEW_EDGES`` are solved without any. Null ends and loops are
    left out. No edges give no rows.
    """
    canonical = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen = written(canonical.distinct()), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen, before = state, now
        if state[0] <= FEW_EDGES:
            now = written(before.coalesce(1).mapInArrow(_solved, "u long, v long"))
            discard(before)
            break
        now = written(_small_star(_linked_to_least(before)))
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
