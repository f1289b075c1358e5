"""Connected components by hooking and contraction, with tables cut off in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lookup


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b); component is the smallest node reachable.

    In each round every node hooks to the neighbour of least rank (a hash of the node, so that chains are short), the
    links are rewritten to the hooked nodes, and self-links go. A round removes at least half of the nodes that have links.
    A node with very many links is summed map-side and looked up as a hot key. Links that are there twice count once, a link of a node
    with itself not at all, and a link with a null node is none; an empty table gives no rows."""
    spark = links.sparkSession
    rank = rank_of
    edges = durable(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "cc-edges")
    names: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.count("*").alias("n"), F.min(rank("v")).alias("m"))
        hook = durable(low.select("u", "n", F.when(F.col("m") < rank_of("u"), F.col("m.v")).otherwise(F.col("u")).alias("p")), "cc-hooks")
        total = 2 * edges.count()
        one = lookup(edges.withColumnRenamed("a", "u"), hook, ["u"], "n", total, "inner").select(F.col("b").alias("u"), F.col("p").alias("pa"))
        two = lookup(one, hook, ["u"], "n", total, "inner").select("pa", F.col("p").alias("pb"))
        edges = durable(two.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        step = hook.select("u", "p")
        if names is None:
            names = durable(step.select(F.col("u").alias("node"), F.col("p").alias("root")), "cc-names")
        else:
            sizes = durable(names.groupBy(F.col("root").alias("u")).agg(F.count("*").alias("n")).join(step, "u"), "cc-sizes")
            moved = lookup(names.withColumnRenamed("root", "u"), sizes, ["u"], "n", names.count())
            names = durable(moved.select("node", F.coalesce("p", "u").alias("root")), "cc-names")
    if names is None:
        return spark.createDataFrame([], "node long, component long")
    least = durable(names.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")), "cc-least")
    return lookup(names, least, ["root"], "n", names.count(), "inner").select("node", "component")


def rank_of(c: str):
    return F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
