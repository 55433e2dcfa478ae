"""Constraints as queries: keys, references, checks, and agreement between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their counts."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def foreign_key_violations(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose (non-null) reference has no parent."""
    p = parent.select(*(F.col(v).alias(k) for k, v in on.items())).distinct()
    return child.dropna(subset=list(on)).join(p, list(on), "left_anti")


def check_counts(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """(rule, violations) of SQL conditions that must hold (null doesn't violate), in one pass."""
    row = df.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(n) for n, c in checks.items()))
    return row.unpivot([], list(checks), "rule", "violations")


def coverage(found: DataFrame, universe: DataFrame, label: str) -> DataFrame:
    """One row: labels in the universe, covered, missing, and seen outside it."""
    f = found.select(label).distinct().withColumn("f", F.lit(1))
    u = universe.select(label).distinct().withColumn("u", F.lit(1))
    j = f.join(u, label, "full_outer")
    return j.agg(
        F.count("u").alias("universe"), F.count_if(F.col("u").isNotNull() & F.col("f").isNotNull()).alias("covered"),
        F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("u").isNull()).alias("outside"),
    )


def compatible(expected: Mapping, cached: Mapping, strict: bool) -> list[str]:
    """Keys in which a cache's metadata disagree; lenient mode looks at the shared keys only."""
    keys = set(expected) | set(cached) if strict else set(expected) & set(cached)
    return sorted(k for k in keys if expected.get(k) != cached.get(k))
