"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.session import settled


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the component's smallest node.

    Large stars hang every larger neighbour of a node on its smallest neighbour, small stars every smaller one;
    repeated in turn, each component becomes one star around its smallest node, in a logarithmic number of
    rounds. Each round is an aggregate and a join over links; nothing but a count and a checksum of the links
    comes to the driver, and every table is written to the shared folder. A node with very many links is
    split by the adaptive skew join, since both sides are written tables.
    """
    tree = settled(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = settled(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star"
        )
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        tree = settled(hung.unionByName(own).filter("u <> v").distinct(), "small-star")
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = tree.select("v").distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
