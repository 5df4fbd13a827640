"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlake.session import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the edges (a, b); the component is its smallest node.

    Alternates large-star and small-star steps, which keep the graph's
    components, never hold a node's neighbours in one row and end after about
    log2 of the longest path. Every round is written to the shared folder.
    Null ends and loops are ignored; without edges there are no rows.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = checkpointed(now)
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(heads)
