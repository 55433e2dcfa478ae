"""Label lists of items: counts, primary labels, label spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNCATEGORIZED = "__uncategorized__"


def with_labels(items: DataFrame, id_col: str, labels: str, drop_empty: bool = False) -> DataFrame:
    """(id, label): one row per label; an item without any gets the uncategorized label, or no row."""
    lists = F.col(labels) if drop_empty else F.when(F.size(F.coalesce(labels, F.array())) > 0, F.col(labels)).otherwise(F.array(F.lit(UNCATEGORIZED)))
    return items.select(id_col, F.explode(lists).alias("label"))


def label_counts(items: DataFrame, id_col: str, labels: str) -> DataFrame:
    return with_labels(items, id_col, labels).groupBy("label").agg(F.count("*").alias("n"))


def primary_labels(items: DataFrame, id_col: str, labels: str, protect: int) -> DataFrame:
    """Each item's globally rarest label (ties by name) and whether fewer than ``protect`` items
    share it as theirs."""
    x = with_labels(items, id_col, labels)
    counts = x.groupBy("label").agg(F.count("*").alias("n"))
    p = x.join(counts, "label").groupBy(id_col).agg(F.min(F.struct("n", "label")).alias("m")).select(id_col, F.col("m.label").alias("primary_label"))
    return p.withColumn("protected", F.count("*").over(Window.partitionBy("primary_label")) < protect)


def label_space(items: DataFrame, id_col: str, labels: str) -> DataFrame:
    """Distinct labels in code-point order with their index."""
    x = with_labels(items, id_col, labels, drop_empty=True).select("label").distinct()
    return x.withColumn("idx", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))


def canonical(items: DataFrame, id_col: str, labels: str, space: DataFrame, strict: bool = False) -> DataFrame:
    """Known labels only, once each, in the space's order; ``strict`` fails on unknown ones."""
    x = with_labels(items, id_col, labels, drop_empty=True).distinct()
    if strict and not x.join(space, "label", "left_anti").isEmpty():
        raise ValueError("labels outside the label space")
    g = x.join(space, "label").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "label"))).alias("x"))
    return items.select(id_col).join(g, id_col, "left").select(id_col, F.coalesce("x.label", F.array().cast("array<string>")).alias("labels"))
