"""Connected components of an edge table by alternating large-star and
small-star steps. Nothing is collected but two counters a round; every step is
a partial aggregate (smallest neighbour) and an equi-join that adaptive
execution can split, so one node with very many links is no hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # edges hold u > v, so the larger neighbours of a node are the u of its rows as v
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return larger.join(least, "u").filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node
    of its component. Links may repeat, in either direction; nulls and self
    links are left out."""
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = stored(edges)
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    before = None
    while True:
        now = edges.agg(mark.alias("m")).first()["m"]
        if now == before or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
        following = stored(_small_star(_large_star(edges)))
        discard(edges)
        edges = following
