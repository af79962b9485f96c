"""Connected components over an edge table, by alternating large-star and small-star rounds until few edges are left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise, small_batches

#: So many edges of two numbers or short keys are settled in one task.
FEW_EDGES = 200_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return row[0], row[1]


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, comp of all nodes of the edges u, v: roots take the lesser root across an edge, then are followed to their end."""
    held = list(batches)
    if not held:
        return
    edges = pa.Table.from_batches(held)
    ends = pa.chunked_array([*edges.column("u").chunks, *edges.column("v").chunks])
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.sort_indices(nodes))
    u, v = (pc.index_in(edges.column(c), nodes).to_numpy() for c in ("u", "v"))
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield from pa.table([nodes, nodes.take(pa.array(root))], names=["node", "comp"]).to_batches(max_chunksize=10_000)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for each node of the edges (u, v); comp is the least node of the component.

    Each round is two grouped minima joined back to the edges; groups are pre-aggregated, and the
    adaptive planner may split the joins, so a hub of many edges does not fall to one task.
    Rounds are cut by tables in the shared folder; their edges are counted, and as soon as there are
    no more than FEW_EDGES, one task settles what is left, so that small graphs do not cost the driver
    a dozen stages a round. No edges give an empty table; loops are dropped.
    """
    spark = edges.sparkSession
    small_batches(spark)
    now, path = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] <= FEW_EDGES:
            kind = now.schema["u"].dataType.simpleString()
            return now.coalesce(1).mapInArrow(_settled, f"node {kind}, comp {kind}")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = materialise(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new, new_path = materialise(small, "cc")
        discard(spark, path, large_path)
        now, path = new, new_path
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
