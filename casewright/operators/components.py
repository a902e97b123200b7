"""Connected components by hooking and shortcutting, as joins with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.storage import discard, materialize


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every node of ``edges`` (src, dst); component is the smallest id reachable.

    Each round hooks a component to the smallest one it touches and then follows the labels
    once (label of the label), so rounds grow with the logarithm of the longest path. Rounds are
    written tables, columnar and in the shared folder.
    """
    links = edges.select("src", "dst").where("src <> dst")
    both = materialize(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("dst"), F.col("component").alias("there")), "dst")
        seen = seen.join(labels.select(F.col("id").alias("src"), F.col("component").alias("here")), "src")
        hooks = seen.where("there < here").groupBy(F.col("here").alias("root")).agg(F.min("there").alias("to"))
        moved = labels.join(hooks, labels["component"] == hooks["root"], "left").select("id", F.coalesce("to", "component").alias("now"), "component")
        up = moved.select(F.col("id").alias("now"), F.col("now").alias("upper"))
        moved = moved.join(up, "now", "left").select("id", F.coalesce("upper", "now").alias("component"), (F.coalesce("upper", "now") != F.col("component")).alias("changed"))
        moved = materialize(moved, "labels")
        changed = not moved.where("changed").isEmpty()
        discard(labels)
        labels = moved
        if not changed:
            discard(both)
            return labels.select("id", "component")
    raise RuntimeError("components did not settle")
