"""Connected components of an edge table, without collecting edges or components.

Alternating large-star / small-star rounds (Kiveris et al., 2014). Each round is a
partially aggregated minimum and a join, so a hub's neighbours never meet in one
task; every task first shrinks its own edges to a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._store import discard, materialize

EDGE = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) for every non-root node of the given edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return np.array(nodes, dtype=np.int64), np.array([find(x) for x in nodes], dtype=np.int64)


def _local_forest(batches):
    """Spanning forest of a task's edges, folded every million edges so memory is bounded by its nodes."""
    held_a, held_b, waiting = [], [], 0

    def fold():
        a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
        return [a], [b]

    for batch in batches:
        held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        waiting += batch.num_rows
        if waiting > 1_000_000:
            held_a, held_b = fold()
            waiting = 0
    if held_a:
        held_a, held_b = fold()
        yield pa.RecordBatch.from_arrays([pa.array(held_a[0], pa.int64()), pa.array(held_b[0], pa.int64())], names=["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node with an edge to another; component is its smallest reachable id.

    ``edges``: columns a, b (long). Loops and repeats are allowed; rows with a null end
    are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialize(edges.mapInArrow(_local_forest, EDGE), "cc")
    mark = None
    for _ in range(max_rounds):
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark or not got[0]:
            break
        mark = tuple(got)
        before, now = now, materialize(_stars(now), "cc")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
