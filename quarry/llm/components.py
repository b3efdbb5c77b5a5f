"""Connected components of an edge table, wholly as joins and aggregates.

Rounds of large-star and small-star steps (Kiveris et al., Connected Components
in MapReduce and Beyond, 2014) pull every vertex towards the smallest id of
its component. Each task first replaces its own edges by stars, which takes
most of the work out of the rounds. Aggregates combine before they shuffle and
a hot vertex's side of a join can be split, so no vertex's edges need to meet
in one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import materialize


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root and p != x:
            parent[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            lo, hi = min(a, b), max(a, b)
            self.parent[hi] = lo
            self.parent.setdefault(lo, lo)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def contract(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """Each task's edges (u, v) replaced by stars with the same components;
    a task flushes when it holds most vertices, so memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()

        def flush() -> pa.RecordBatch:
            rows = sets.stars()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a != b:
                    sets.union(a, b)
            if len(sets.parent) > most:
                yield flush()
                sets = UnionFind()
        yield flush()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) for each vertex of edges (a, b) that has an edge to
    another; component_id is the component's smallest id. Null ends count as
    no edge."""
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialize(contract(e).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: each larger neighbour is linked to the smallest one
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each smaller neighbour, and the vertex, to the smallest
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        seen = Observation()
        e = materialize(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("h"), F.sum(F.col("v") % (1 << 31)).alias("v")), "edges")
        mark = seen.get
        if mark == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = mark
    raise RuntimeError("components did not settle")


def labelled(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """ids (id and more) with component_id; ids without edges are their own."""
    return ids.join(components(edges), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))


def union_counts(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stars with the components of the edges (a[i], b[i])."""
    sets = UnionFind()
    for x, y in zip(a.tolist(), b.tolist()):
        sets.union(x, y)
    return sets.stars()
