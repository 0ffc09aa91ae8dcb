"""Connected components by contraction, for vertices that are hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlens.session import cut


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links (a, b).

    Each round sends every vertex to its least neighbour and replaces the ends of the links by where they went,
    until no link is left. Vertices are hashes, so their order is random and a round keeps at most about half of
    them. Rounds only aggregate with a minimum (combined before the shuffle) and join on vertices.
    """
    ends = cut(links.where("a <> b").select("a", "b").distinct(), "links")
    maps: list[DataFrame] = []
    while not ends.isEmpty():
        both = ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("root")), "least")
        maps.append(to)
        left, right = to.select(F.col("v").alias("a"), F.col("root").alias("ra")), to.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        ends = cut(ends.join(left, "a").join(right, "b").where("ra <> rb")
                   .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not maps:
        return ends.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        later = out.select(F.col("v").alias("root"), F.col("root").alias("__to"))
        out = cut(m.join(later, "root", "left").select("v", F.coalesce("__to", "root").alias("root")), "roots")
    return out
