"""Graph jobs as checkpointed DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.scratch import drop_scratch, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): component is the least id reachable.

    Each round hooks a node and its parent to the least parent among its neighbours and then halves paths, so rounds grow with
    the logarithm of the longest path. Each round's labels are written to the shared folder; neighbours combine map-side.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("f")), "labels")
    while True:  # labels only fall, so this ends
        near = both.join(labels.select(F.col("id").alias("b"), "f"), "b").groupBy(F.col("a").alias("id")).agg(F.min("f").alias("m"))
        near = near.join(labels, "id")
        hook = near.select("id", "m").union(near.select(F.col("f").alias("id"), "m")).groupBy("id").agg(F.min("m").alias("m"))
        hooked = labels.join(hook, "id", "left").select("id", F.col("f").alias("old"), F.least("f", "m").alias("f"))
        up = hooked.select(F.col("id").alias("f"), F.col("f").alias("ff"))
        new = materialize(hooked.join(up, "f").select("id", "old", F.least("f", "ff").alias("f")), "labels")
        drop_scratch(labels)
        labels = new.select("id", "f")
        if new.filter("f <> old").isEmpty():
            break
    drop_scratch(both)
    return labels.select("id", F.col("f").alias("component"))
