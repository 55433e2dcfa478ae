"""Connected components of a link table by alternating star contraction.

Each round every node links its larger neighbours, then its smaller ones, to the least node it
sees; the table of links never grows beyond its first size and settles in a few rounds.  Rounds go
on until nothing changes: a result is never returned unfinished.  A node with very many neighbours
is only ever aggregated with a map-side minimum and joined in a way that lets the engine split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import apart, cut, forgetful


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the least node of its component.

    No links, no rows.  Self-links and repeated links are harmless.
    """
    e = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while not _stars(e):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(apart(low, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(low, "a"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            small.select("a", F.col("m").alias("b"))
        )
        e = forgetful(cut(small.where("a <> b").distinct()))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none."""
    ends = e.groupBy("a").agg(F.count("*").alias("down"), F.lit(0).alias("up"))
    ends = ends.unionAll(e.select(F.col("b").alias("a")).distinct().select("a", F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("a").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 OR down * up > 0").isEmpty()
