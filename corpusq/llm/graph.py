"""Connected components of large graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that a task holds at once.
EDGES = 500_000


def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The components of some edges: each node but the smallest of its component, and that smallest one."""
    nodes = pc.unique(pa.concat_arrays([a, b]))
    nodes = nodes.take(pc.sort_indices(nodes))
    x, y = (pc.index_in(n, nodes).to_numpy(zero_copy_only=False).astype(np.int64) for n in (a, b))
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes.take(pa.array(far)), nodes.take(pa.array(root[far]))


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b) -> edges that join the same nodes, b < a: of every EDGES that a task reads, the stars of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= EDGES:
                yield star_batch(held)
                held = []
        if held:
            yield star_batch(held)

    def star_batch(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.record_batch(list(stars(*(pa.concat_arrays([h.column(k) for h in held]) for k in range(2)))), names=["a", "b"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def settled(edges: DataFrame) -> bool:
    """Whether all edges are stars around their smallest node: each node has one edge to a smaller one, or none if others
    have it as theirs. Repeated edges count once."""
    ends = edges.select(F.col("a").alias("node"), "b", F.lit(False).alias("centre")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast(edges.schema["b"].dataType).alias("b"), F.lit(True).alias("centre")))
    seen = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("centre").alias("centre"))
    return seen.where("low < high or low is not null and centre").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of some edge; a component is named by its smallest node.

    Large-star and small-star steps take turns until all edges are stars: a node's neighbours are hooked to the
    smallest node around it. Before that and after each round, the edges that a task holds are contracted to the stars
    of their components, so few rounds are left; their number grows with the logarithm of the longest path. Each round
    is a written table, in no more files than its edges need; neighbours are never gathered, only their minimum is.
    """
    e = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    e = written(contracted(e), "edges")  # from its own table, as each Python step of a task has a worker
    cores = edges.sparkSession.sparkContext.defaultParallelism
    while not settled(e):
        files = max(cores, -(-2 * e.count() // EDGES))
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        e = written(contracted(small.coalesce(files)), "edges")
    named = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
