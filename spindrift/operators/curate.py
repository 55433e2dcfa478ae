"""Curation from end to end: neighbours, graph, communities, ranks, quotas and representatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import sampling as P
from spindrift.operators import tuning
from spindrift.operators import vectors as V
from spindrift.operators.labels import primary_labels
from spindrift.sources import artifacts as A
from spindrift.sources import atomic

Neighbours = Callable[[DataFrame, str, str, int], DataFrame]


def exact(items: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    return V.knn(items, items, id_col, vec_col, k)


def approximate(items: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """For corpora where comparing all pairs is out of reach."""
    return V.knn_approximate(items, items, id_col, vec_col, k)


def clustered(
    items: DataFrame, id_col: str, vec_col: str, neighbours: Neighbours = exact, side: str = "max", fallback: float = 0.5, attach_q: float = 0.5, largest: int | None = None
) -> DataFrame:
    """(id, cluster) of all items: communities of the similarity graph whose parameters go by the
    number of items, singletons attached to a near cluster, then paired.  Ids are whole numbers.

    One item or none has itself as its cluster.
    """
    items = items.select(id_col, vec_col)
    n = items.count()
    nodes = items.select(F.col(id_col).cast("long").alias("node"))
    if n < 2:
        return nodes.select(F.col("node").alias(id_col), F.col("node").alias("cluster"))
    p = items.sparkSession.range(1).select(tuning.recommended(F.lit(n), side).alias("p")).first()["p"]
    near = V.cut(neighbours(items, id_col, vec_col, p.top_k))
    found = V.communities(V.graph_edges(near, p.q_sim / 100, fallback, p.use_mutual, p.max_edges_per_node), nodes, tuple(p.resolutions), largest)
    threshold = V.percentile(near.where("rank = 1"), "sim", attach_q, fallback).first()[0]
    found = V.attach_singletons(found, near.where(F.col("rank") <= p.attach_neigh_k), threshold)
    found = V.pair_singletons(found, near.where(F.col("rank") <= p.pair_k), threshold)
    return V.cut(found.select(F.col("node").alias(id_col), "cluster"))


def picked(ranked: DataFrame, id_col: str, num: int, cap: int, growth: str = "log", gap_side: str = "right") -> DataFrame:
    """(id, cluster, rank, dist) of representatives: quotas by cluster size, then the members at the
    gaps of the distance to the centre."""
    sizes = ranked.groupBy("cluster").agg(F.count("*").alias("size"))
    quota = P.allocate(sizes, "cluster", "size", num, cap, growth).select("cluster", F.col("k").alias("_k"))
    return V.gap_representatives(ranked.join(quota, "cluster").where("_k > 0"), id_col, "cluster", F.col("_k"), gap_side).select(id_col, "cluster", "rank", "dist")


def curate(
    items: DataFrame, id_col: str, vec_col: str, text_col: str, dim: int, num: int, cap: int, path: str, growth: str = "log", gap_side: str = "right", **how
) -> DataFrame:
    """The picked rows of ``items``, with cluster, rank and dist, by way of artifacts written to
    ``path``: a run that finds them whole picks from them and clusters nothing."""
    spark = items.sparkSession
    if not atomic.exists(spark, f"{path}/meta.json"):
        members = items.select(id_col, vec_col, text_col).join(clustered(items, id_col, vec_col, **how), id_col)
        ranked = V.centroid_ranks(members, id_col, "cluster", vec_col, dim)
        records = ranked.join(items.select(id_col, text_col), id_col).select(
            F.col(id_col).cast("long").alias("idx"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col("cluster").alias("cluster_id"),
            F.col("sim").alias("sim_to_centroid"), F.col("dist").alias("dist_to_centroid"), F.col("rank").alias("rank_in_cluster"),
        )
        centres = V.centroids(members, "cluster", vec_col, dim).withColumnRenamed("cluster", "cluster_id")
        A.write_artifacts(records, centres, path, {"num": num, "cap": cap, "growth": growth})
    kept = A.read_artifacts(spark, path, ("idx", "cluster_id", "dist_to_centroid", "rank_in_cluster"))["records"]
    kept = kept.select(F.col("idx").alias(id_col), F.col("cluster_id").alias("cluster"), F.col("dist_to_centroid").alias("dist"), F.col("rank_in_cluster").alias("rank"))
    sizes = kept.groupBy("cluster").agg(F.count("*").alias("size"))
    chosen = picked(kept.join(sizes, "cluster"), id_col, num, cap, growth, gap_side)
    return items.drop("cluster", "rank", "dist").join(chosen, id_col)


def curate_by_label(
    items: DataFrame, id_col: str, vec_col: str, text_col: str, labels: str, dim: int, protect: int, share: float, cap: int, path: str, only: Sequence[str] | None = None, **how
) -> DataFrame:
    """(id, primary_label, protected): items go to the rarest of their labels; all of a label with
    fewer than ``protect`` items stay, of any other a ``share`` of them, curated by itself.

    The labels are a list that the driver may hold; ``only`` names some of them.  Items without a
    label are left out.
    """
    home = V.cut(primary_labels(items.select(id_col, labels), id_col, labels, protect))
    sizes = home.groupBy("primary_label", "protected").agg(F.count("*").alias("n")).orderBy("primary_label").collect()  # a row a label
    out = home.where("protected")
    if only is not None:
        out, sizes = out.where(F.col("primary_label").isin(list(only))), [r for r in sizes if r.primary_label in only]
    for k, r in enumerate(x for x in sizes if not x.protected):
        own = items.join(home.where(F.col("primary_label") == r.primary_label).select(id_col), id_col, "left_semi")
        got = curate(own, id_col, vec_col, text_col, dim, max(1, round(share * r.n)), cap, f"{path}/label={k}", **how)
        out = out.unionByName(home.join(got.select(id_col), id_col, "left_semi"))
    return out
