"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) longs, any order, repeats and loops allowed; rows without an end are left out, no edges give no
    nodes.  Returns (node, root): the smallest node reachable.  Each round every node takes the smallest root among its
    neighbours' and then its root's root, so long chains halve; the table of labels is
    written to the shared folder each round, which cuts the lineage.  Sums per node are
    partial before the shuffle, so a node with many neighbours costs one row per task."""
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = common.write_shared(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root"))
    labels = common.write_shared(labels, "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # a hook: the old root learns of the smaller root as well
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hooks = step.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        # tables of their own: a root that many nodes share is then one key of a plain join, which Spark splits
        step, hooks = common.write_shared(step, "step"), common.write_shared(hooks.withColumnRenamed("node", "root"), "hooks")
        step = step.join(hooks, "root", "left").select("node", "root", F.least("low", F.coalesce("hook", "low")).alias("low"))
        step = common.write_shared(step, "step")
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        step = step.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("lower", "low")).alias("root"), (F.coalesce("lower", "low") != F.col("root")).alias("moved"))
        step = common.write_shared(step, "labels")
        labels = step.select("node", "root")
        if not step.filter("moved").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
