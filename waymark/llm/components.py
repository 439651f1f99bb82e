"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import drop, materialize


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u long, v long) undirected links -> (node, root): root is the smallest node of the component.

    Large-star then small-star per round until the links are stars, told by the sums of the links' hashes. Minima are combined
    before their shuffle and joined back; a hub's links are the splittable side of that join, which adaptive execution deals out
    where they are many. The links of a round are deleted when the next ones are written. Nulls and
    self-links are ignored; repeated links count once; an empty table gives an empty result.
    Nodes without a link are not returned.
    """
    edges = materialize(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
        .distinct()
    )
    seen = _signature(edges)
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(edges)))
        drop(edges)
        # stars: every node has one link, to a root that has no smaller neighbour
        edges, before, seen = after, seen, _signature(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _signature(edges: DataFrame) -> tuple:
    """Count and two hash sums of distinct links."""
    a, b = F.xxhash64("hi", "lo"), F.xxhash64("lo", "hi")
    return tuple(edges.agg(F.count("*"), F.bit_xor(a), F.bit_xor(b), F.sum(a.cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour to the smallest of the neighbourhood (itself included)."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours and the node itself to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
