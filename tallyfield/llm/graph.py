"""Connected components of an edge table, without collecting links or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm._spark import cut, sized_broadcast, written


class Union:
    """Disjoint sets over 0 .. n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Unite; False if they were one set already."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as a forest of stars; an edge of each vertex to the smallest one it reaches."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not held:
        return
    edges = np.unique(np.concatenate(held), axis=0)
    names, at = np.unique(edges, return_inverse=True)
    at = at.reshape(edges.shape)
    sets = Union(len(names))
    for x, y in at.tolist():
        sets.join(x, y)
    root = np.fromiter((sets.find(x) for x in range(len(names))), np.int64, len(names))
    yield pa.RecordBatch.from_pydict({"a": names, "b": names[root]})


#: Edges that one task contracts.
EDGES = 500_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root): the smallest vertex that each vertex of an edge reaches.

    Edges are dealt to as many tasks as hold EDGES each, which contract theirs to stars; if it
    is one task, that is all.  Else each round gives a vertex the least label of its neighbours
    and follows labels once more (pointer jumping), until nothing changes.  The labels' own
    labels are a row a component, which is broadcast if small, so that one large component is
    no hot key.  Rounds are cut by reliable checkpoints.  An edge table without rows gives none.
    """
    pairs = written(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b"))
    tasks = max(1, -(-pairs.count() // EDGES))
    stars = pairs.repartition(tasks).mapInArrow(_contract, "a long, b long")
    if tasks == 1:
        return written(stars.select(F.col("a").alias("vertex"), F.col("b").alias("root")))
    stars = written(stars.filter("a <> b"))
    both = cut(stars.select(F.col("a").alias("v"), F.col("b").alias("w")).union(stars.select("b", "a")).distinct())
    labels = cut(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("root").alias("_r")), "w").groupBy("v").agg(F.min("_r").alias("_r"))
        lower = cut(labels.join(near, "v").select("v", F.col("root").alias("_was"), F.least("root", "_r").alias("root")))
        roots = lower.select("root").distinct()
        jump = lower.select(F.col("v").alias("root"), F.col("root").alias("_up")).join(roots, "root", "left_semi")  # a row a component, not a vertex
        new = cut(lower.join(sized_broadcast(written(jump)), "root").select("v", "_was", F.least("root", "_up").alias("root")))
        moved = new.filter("root <> _was").limit(1).count()
        labels = new.select("v", "root")
        if not moved:
            return labels.select(F.col("v").alias("vertex"), "root")
