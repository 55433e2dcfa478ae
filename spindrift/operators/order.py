"""Positions and running sums over a whole table without bringing it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.vectors import cut


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """``df`` with, by name, the sum of a column over all rows up to and with the row's own, in an
    order that is total.

    Rows are dealt to tasks by ranges of the order and written once; each task sums its own, and what
    the ranges before it hold is a row a range.
    """
    own = {f"_s{k}": c if isinstance(c, Column) else F.col(c) for k, c in enumerate(sums.values())}
    d = df.withColumns(own) if own else df
    d = cut(d.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("_p").agg(*(F.sum(s).alias(f"{s}_t") for s in own))  # a row a range
    parts = parts.select("_p", *(F.coalesce(F.sum(f"{s}_t").over(before), F.lit(0)).alias(f"{s}_b") for s in own))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(F.broadcast(parts), "_p").withColumns({name: F.sum(s).over(inside) + F.col(f"{s}_b") for name, s in zip(sums, own, strict=True)})
    return d.drop("_p", *own, *(f"{s}_b" for s in own))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 0) -> DataFrame:
    """``df`` with each row's place in a total order, from ``first``."""
    out = running(df, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) + (first - 1)) if first != 1 else out


def with_total(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with aggregates over all its rows: one row, joined back."""
    return df.join(F.broadcast(df.agg(*(c.alias(k) for k, c in totals.items()))))
