"""Connected components of a link table: repeated contraction, wholly distributed, until one task can settle what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Up to so many links (16 bytes each) are settled by one task, beyond that a round of contraction comes first.
SETTLED = 1 << 14


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the smallest node of its component, by union-find."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def roots(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a, b) of longs; root is the smallest node of the component.

    Each round every node follows its smallest neighbour, or itself if none is smaller; links are carried
    over to those parents, loops and repeats dropped. A component loses at least half of its nodes a round,
    so rounds grow with the logarithm of the largest component. Tables are written between rounds. The last links
    go to one task; each round costs the driver a dozen jobs, which small tables need not.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, nodes = runtime.written(links.select("a", "b").where("a <> b").distinct(), "links"), None
    while edges.count() > SETTLED:
        if nodes is None:
            nodes = runtime.written(both(edges).select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
        parents = both(edges).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        first = runtime.written(parents, "parents")
        # two steps at once where the parent itself moves on
        p2 = first.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parents = runtime.written(first.join(p2, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents")
        of = lambda c: parents.select(F.col("a").alias(c), F.col("p").alias(f"{c}_root"))  # noqa: E731, B023
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        left = runtime.written(moved.where("a <> b").distinct(), "links")
        named = _renamed(nodes, parents.select(F.col("a").alias("node"), F.col("p").alias("root")))
        runtime.dropped(edges, nodes, first, parents)
        edges, nodes = left, named
    last = runtime.written(edges.coalesce(1).mapInArrow(runtime.tidied(_settled), "node long, root long"), "nodes")
    if nodes is not None:
        named = _renamed(nodes, last)
        runtime.dropped(nodes, last)
        last = named
    runtime.dropped(edges)
    return last


def _renamed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes(node, root) with the roots that have one of their own in roots(node, root) replaced by it."""
    of = roots.select(F.col("node").alias("root"), F.col("root").alias("of"))
    return runtime.written(nodes.join(of, "root", "left").select("node", F.coalesce("of", "root").alias("root")), "nodes")
