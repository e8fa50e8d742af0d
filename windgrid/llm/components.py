"""Connected components by repeated contraction, with no node's neighbours ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windgrid.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp for every node of links (a, b); comp names the component by one of its nodes.

    In each round every node joins the neighbour (or itself) that a hash, new in each round, puts
    first; links are then between what the nodes joined, and a constant share of the nodes is gone.
    A round aggregates one row per node, so hubs are no hot spots.
    """
    edges = scratch.save(links.select("a", "b").where("a <> b").distinct(), f"{name}_edges_0")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    owner = scratch.save(nodes.select("node", F.col("node").alias("comp")), f"{name}_owner_0")
    k = 0
    while not edges.isEmpty():
        k += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("r"), c.alias("v"))  # noqa: E731, B023
        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.least(F.min(rank(F.col("b"))), F.first(rank(F.col("a")))).getField("v").alias("to"))
        first = scratch.save(first.withColumnRenamed("a", "old"), f"{name}_first_{k}")
        step = lambda df, c: df.join(first.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731, B023
        moved = step(step(edges, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = scratch.save(moved.where("a <> b").distinct(), f"{name}_edges_{k}")
        owner = scratch.save(step(owner, "comp").select("node", "comp"), f"{name}_owner_{k}")
        scratch.drop(f"{name}_edges_{k - 1}", f"{name}_owner_{k - 1}", f"{name}_first_{k}")
    return owner
