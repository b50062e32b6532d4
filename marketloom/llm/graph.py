"""Connected components by alternating large and small stars, all in joins and minimum aggregates.

Before each round every task replaces the edges that it reads by a spanning forest of them, in slices, so rounds are
few; a round ends once all components are stars, which one aggregate by node tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, stash, sweep

EDGE = "u long, v long"
#: So many edges at least are put into one forest, if a task has them.
SLICE = 1 << 18


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the least node that it reaches over them, without that node itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (a, b) = np.arange(len(nodes)), at.reshape(2, -1)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[moved], nodes[root[moved]]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        u, v = _forest(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= SLICE:
            yield made()
            held = []
    if held:
        yield made()


def _thinned(edges: DataFrame) -> DataFrame:
    """The edges (u > v), stashed: those of each task's forest. Written first as they come, so that a task has as many as a file is worth."""
    raw = stash(edges.filter("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    out = stash(raw.mapInArrow(_forests, EDGE))
    discard(raw)
    return out


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """large: link each greater neighbour of u to u's least neighbour; small: link u and its lesser neighbours to the least of them. few: a table of a row a node may be broadcast."""
    e = _both_ways(edges)
    if not large:
        e = e.filter("v < u")
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = e.join(F.broadcast(least) if few else least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v")
    return out if few else out.distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of the edges (u > v) has one v, which is no u itself: then v is the least node of the component."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("v").alias("to")))
    nodes = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node")
    return nodes.agg(F.min("to").alias("a"), F.max("to").alias("b")).filter("a <> b").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node that it reaches.

    Loops and repeated edges don't matter; nodes without edges are not listed. Each round is written to
    the shared folder, so a lost executor costs one round at most; the rounds grow with the logarithm of
    the longest path. Raises if max_rounds don't suffice.
    """
    now = _thinned(edges)
    for _ in range(max_rounds):
        few = 2 * now.count() <= BROADCAST_ROWS
        if _are_stars(now):
            now = now.distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, now = now, _thinned(_star(_star(now, True, few), False, few))
        discard(before)
        sweep(now.sparkSession)
    raise RuntimeError("the components did not settle")
