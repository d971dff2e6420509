"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.shared import Scratch

#: Parts that the nodes of one label are dealt into where they look the label up.
SALTS = 16


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); the label is the least node.

    Each round takes the least label among a node's neighbours and then the label's own label, so a
    path of n nodes needs about log n rounds. A round reads and writes tables; nothing is collected but
    whether something changed. All members of a large class look up one label: only labels that have
    moved on are looked up, and a label's members are dealt into ``SALTS`` parts.

    An edge with a null end, and one from a node to itself, is left out, so a node without other edges
    isn't in the result; edges that repeat count once; no edges give no rows.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}-0")
    salt, k = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"), 0
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("near"))
        best = scratch.keep(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"), salt.alias("salt")), f"{name}-best{k}")
        moved = best.select("best").distinct().join(best.select(F.col("node").alias("best"), F.col("best").alias("further")), "best").where("further <> best")
        moved = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        jumped = best.join(moved, ["best", "salt"], "left").select("node", F.coalesce("further", "best").alias("new"), "label")
        new = scratch.keep(jumped.select("node", F.col("new").alias("label"), (F.col("label") != F.col("new")).alias("changed")), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}", f"{name}-best{k}")
        labels, k = new.select("node", "label"), k + 1
        if new.where("changed").limit(1).count() == 0:
            scratch.drop(f"{name}-edges")
            return labels
