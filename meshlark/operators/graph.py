"""Connected components over edge tables (alternating large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.storage import checkpoint


def _minima(pairs: DataFrame, by: str, of: str, name: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.min(of).alias(name))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; a component's id is its smallest node.

    Each round rewires every node to the smallest node it can see, first towards larger and then
    towards smaller neighbours (Kiveris et al., 2014); rounds grow with the logarithm of the
    diameter. Minima are pre-aggregated before the shuffle, so a hub is not collected anywhere,
    and each round is checkpointed in the shared folder. Null ends and self-loops: a self-loop
    yields its node alone, rows with a null end are ignored. An empty table gives an empty table.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    alone = nodes.where("u = v").select("u")
    star, seen = nodes.where("u > v"), None
    for _ in range(max_rounds):
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both, "u", "v", "m").select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = _minima(large, "u", "v", "m").withColumnRenamed("u", "k")
        small = large.join(low, large.u == low.k).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = checkpoint(small.union(low.select("k", "m")).distinct())
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = star.select("v").union(alone.join(star, alone.u == star.u, "left_anti").select("u")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
