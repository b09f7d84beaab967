"""Connected components of a link table, by alternating star contractions.

Each round rewires every link towards the smallest node in reach (first the
larger neighbours of a node, then the smaller ones), and ends when the links
no longer change: then every link leads to its component's smallest node.
Rounds grow with the logarithm of a component's width; each is cut by a
reliable checkpoint. Minima are pre-aggregated before the shuffle, so a node
with very many links is no single task's load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rewired = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rewired.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``links`` has columns ``a`` and ``b`` (both long). Returns ``node`` and
    ``root`` (the component's smallest node) for every node that isn't its
    own root."""
    links = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        links = cut(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
