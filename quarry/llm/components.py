"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the smallest id reachable.

    Alternates large and small stars: each node points its neighbours at the smallest of them,
    first those above it, then those below. Neighbours are never gathered: a node's smallest one
    is an aggregate with partial results. Links that repeat, loops and nulls change nothing.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:  # ends: each round that changes something puts nodes below smaller ones
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        # every link now has its larger end in u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return cut_lineage(stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
