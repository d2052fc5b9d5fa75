"""Connected components of an undirected graph given as edges, without a driver-side graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: Edges that one task finishes, which bounds its memory; more take rounds over all tasks.
FEW = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of some edges, by union-find."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(place[: len(u)].tolist(), place[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return nodes, nodes[[root(i) for i in range(len(nodes))]]


def _contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars of its own components: at most one edge a node and partition."""

    def run(batches):
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list = []
        size = 0

        def merged():
            a = np.concatenate([u, *[x[0] for x in held]])
            b = np.concatenate([v, *[x[1] for x in held]])
            nodes, roots = forest(a, b)
            keep = nodes != roots
            return nodes[keep], roots[keep]

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size > 500_000:
                u, v = merged()
                held, size = [], 0
        if held or len(u):
            u, v = merged()
        for lo in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 100_000]), pa.array(v[lo : lo + 100_000])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u, v) reaches; one row a node.

    Edges first shrink within partitions.  If at most FEW are left, one task finishes them; else large-star and small-star steps alternate
    until each node points at its component's smallest; each round is a table in the shared folder.  Loops and repeated edges do no harm; no
    edges give no rows.
    """
    plain = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    stars = stage(_contract(plain).distinct(), "edges")
    few = stars.count() <= FEW
    if few:
        stars = stage(_contract(stars.repartition(1)), "edges")
    while not few and not _settled(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = stage(small.distinct(), "edges")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(stars: DataFrame) -> bool:
    """Whether each node has one edge, to a node without one."""
    n, nodes = stars.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and not stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1)
