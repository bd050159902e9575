"""Connected components over an edge table, and the group ids built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.operators.ranking import running_total
from corpusops.runtime import written

NUMBERING_SLICES = 64


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): every node of an undirected edge table with the least node connected to it.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the size of a
    component and no node gathers more than its own edges. Every round is cut off in the shared folder. Nodes that are no
    numbers are numbered once, so that the rounds move bigints. Edges with a null end are left out,
    repeated edges and loops change nothing; an empty table gives an empty result.
    """
    if dict(edges.dtypes)[left] != "bigint":
        named = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
        nodes = named.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("__all", F.lit(0))
        ids = written(running_total(nodes, ["__all"], ["node"], F.lit(1), "id", NUMBERING_SLICES).select("node", "id"))
        numbered = named.join(ids.select(F.col("node").alias("u"), F.col("id").alias("a")), "u").join(ids.select(F.col("node").alias("v"), F.col("id").alias("b")), "v").select("a", "b")
        found = written(connected_components(numbered, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("number")).join(ids, "id").select("node", "number"))
        return found.join(found.groupBy("number").agg(F.min("node").alias("component")), "number").select("node", "component")
    u, v = F.col(left).alias("u"), F.col(right).alias("v")
    kept = edges.select(u, v).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = kept.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = written(kept.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = written(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == total:
            break
        total = state
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
