"""Connected components of an edge table that no single machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the component of a node is the smallest node connected with it.

    Alternating large-star and small-star rounds, each a partial aggregate and a join, until the edges no longer
    change; a long path takes a logarithmic number of them. Loops and null ends are ignored, an empty table gives
    an empty result. The edges of each round are written to the shared folder, so the lineage stays short.
    """
    work = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    work = materialize(work, "edges")
    before = None
    for _ in range(max_rounds):
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, work = work, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(last)
        now = work.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    nodes = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
