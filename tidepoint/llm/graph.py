"""Connected components of a table of links, by contraction in stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id of its component) of every id in `links` (a, b).

    In each round every vertex joins the vertex of least random rank within two links, itself included,
    and links are redrawn between what is left; the expected number of rounds is logarithmic whatever
    the shape, and a star is done in one (within one link, half of its leaves would be left each time).
    Least ranks combine before the shuffle, so a vertex with many links is no burden.
    """
    links = stored(links.select("a", "b").where("a <> b"), "links")
    parents = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        ranked = {c: F.struct(F.xxhash64(c, F.lit(len(parents))).alias("rank"), F.col(c).alias("id")) for c in "ab"}
        near = both.groupBy("a").agg(F.min(ranked["b"]).alias("m")).select(F.col("a").alias("b"), F.least("m", ranked["a"]).alias("m"))
        # What a neighbour sees holds the vertex itself.
        best = both.join(near, "b").groupBy("a").agg(F.min("m").alias("m"))
        parent = stored(best.select(F.col("a").alias("id"), F.col("m.id").alias("parent")), "parents")
        parents.append(parent)
        left, right = (parent.select(F.col("id").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        links = stored(links.join(left, "a").join(right, "b").where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if not parents:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = parents[-1].select("id", F.col("parent").alias("root"))
    for parent in reversed(parents[:-1]):
        above = roots.select(F.col("id").alias("parent"), "root")
        roots = parent.join(above, "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))
    roots = stored(roots, "roots")
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(least, "root").select("id", "component")
