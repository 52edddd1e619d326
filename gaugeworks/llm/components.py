"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialize


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least one in u's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return _pairs(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is tied to the least of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _pairs(tied.unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node with an edge in `edges` (u, v: bigint, nulls
    dropped); component is the least node that can be reached. The minimum is combined
    before its shuffle and written out before it is joined: both sides of the join are then
    plain shuffles, and AQE can split a hot node. Each round is written to the shared folder; rounds
    grow with the logarithm of a component's diameter. No edges give no rows."""
    edges = materialize(_pairs(edges.where("u IS NOT NULL AND v IS NOT NULL")), name)
    while True:
        after = materialize(_small_star(_large_star(edges)), name)
        state = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if edges.select(state).first() == after.select(state).first():
            least = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return least.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = after
