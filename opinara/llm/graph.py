"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of ``edges`` (src, dst); component is the
    smallest node reachable.  Each round takes the smallest label among neighbours
    and then the label's own label, so long chains shorten geometrically; labels are
    checkpointed each round and never leave the executors."""
    both = cut(
        edges.where("src <> dst")
        .select("src", "dst")
        .unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .distinct()
    )
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("other")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        new = cut(step.join(up, "label").select("node", "old", F.col("upper").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
