"""Connected components of an edge table, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import materialise, parts_for, scope


def components(edges: DataFrame, nodes: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """(node, comp) for undirected ``edges`` (a, b): comp is the smallest node of the component.

    Labels fall to the smallest neighbouring label, then to the label of their label,
    until none changes; each turn is written to the shared folder.  Joins are on keys
    whose hot values adaptive execution can split, and minima are pre-aggregated.
    Null ends are left out; nodes without edges are only returned if ``nodes`` has them.
    """
    both = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    parts = None if size is None else parts_for(size)
    e = materialise(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(both.alias("x")).select("x.a", "x.b"), "edges", parts)
    labels = materialise(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels", parts)
    while True:
        with scope(e.sparkSession) as paths:  # of a turn only its labels are read again
            offered = e.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("c")), "a").groupBy("b").agg(F.min("c").alias("c"))
            lower = labels.join(offered.select(F.col("b").alias("node"), "c"), "node").select("node", "comp", F.least("comp", "c").alias("low"))
            lower = materialise(lower, "labels", parts)
            jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
            new = materialise(lower.join(jump, "low").select("node", F.least("low", "lowest").alias("comp"), (F.col("comp") != F.least("low", "lowest")).alias("moved")), "labels", parts)
            paths.pop()
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            break
    if nodes is not None:
        labels = nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    return labels
