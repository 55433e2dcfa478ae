"""As-of and interval joins by buckets of time: no task holds more than a bucket of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(at: Column, width: int) -> Column:
    """Where the bucket of a time begins."""
    return at - F.pmod(at, F.lit(width))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, width: int, ties: str) -> DataFrame:
    """``left`` with the value (and ``value_at``) of the last row of ``right`` of its keys at or before
    its time, null for none; of equal times the greatest ``ties`` counts.  A column of ``left`` named
    like the value is replaced.

    ``at`` is a whole number.  Rows meet inside buckets of ``width`` only; what the buckets before
    hand on is one row a bucket.  Rows of ``left`` with a null key or time have no value.
    """
    bucket = _bucket(F.col(at), width)
    held = F.struct(F.col(at).alias("t"), F.col(ties).alias("o"), F.col(value).alias("v"))
    names = [f"_k{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(a) for k, a in zip(keys, names, strict=True)]
    r = right.dropna(subset=[*keys, at]).select(*key_cols, bucket.alias("_b"), F.col(at).alias("_t"), held.alias("_h"))
    left = left.drop(value, f"{value}_at")
    asked = left.select(F.struct(*left.columns).alias("_row"), *key_cols, bucket.alias("_b"), F.col(at).alias("_t"))
    last = r.groupBy(*names, "_b").agg(F.max("_h").alias("_l"))
    # the buckets that rows of ``left`` lie in take the last value of the buckets before
    marks = last.unionByName(asked.select(*names, "_b").distinct(), allowMissingColumns=True)
    marks = marks.groupBy(*names, "_b").agg(F.max("_l").alias("_l"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*names, "_b", F.last("_l", True).over(before).alias("_before"))
    both = asked.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*names, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_in", F.max("_h").over(inside)).where("_row IS NOT NULL")
    j = both.join(marks, [*names, "_b"], "left").withColumn("_x", F.coalesce("_in", "_before"))
    return j.select("_row.*", F.col("_x.v").alias(value), F.col("_x.t").alias(f"{value}_at"))


def in_intervals(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Every point with every span of its keys that holds it (``start`` included, ``end`` not).

    A span stands in each bucket of ``width`` that it touches, so the join is one on keys and
    bucket; a point lies in one bucket, so no pair comes twice.
    """
    p = points.withColumn("_b", _bucket(F.col(at), width))
    s = spans.where(F.col(start) < F.col(end))
    s = s.withColumn("_b", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end) - 1, width), F.lit(width))))
    held = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return p.join(s, [*keys, "_b"]).where(held).drop("_b")
