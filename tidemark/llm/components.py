"""Connected components of a large edge table, by alternating large-star and small-star steps.

Every step is a few shuffles over the edges; nothing about nodes or edges comes to
the driver but a count and a checksum. A node of very high degree is a join
key whose rows Spark may split. Up to FEW_EDGES edges, by count, one task on an
executor finds the same components by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

FEW_EDGES = 200_000


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge; self-loops count as nodes only."""
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(both.filter("u <> v").distinct())
    if e.count() <= few:
        return e.coalesce(1).mapInArrow(union_find, "node long, root long")
    mark = None
    while True:  # every round takes edges nearer to their roots, so this ends, after about log n rounds
        # large star: all larger neighbours of a node go to the smallest of its neighbourhood
        around = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if (now["n"], now["s"]) == mark:
            break
        mark = (now["n"], now["s"])
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
