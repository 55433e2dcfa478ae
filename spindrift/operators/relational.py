"""Joins, existence tests, deduplication, upserts and table synchronisation over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.order import running, with_total


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The last row of each key by position."""
    return keep_first(df, keys, [F.col(position).desc_nulls_last()])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Up to ``n`` rows per group with their 1-based rank; Spark prunes each partition first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def with_flag(df: DataFrame, other: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """EXISTS as a column: whether ``other`` has the row's key."""
    keys = other.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, list(on), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def scoped(df: DataFrame, key: str, ids: Sequence | None, exclude: Sequence = ()) -> DataFrame:
    """Rows in an id scope.  None is unscoped; an empty list selects nothing."""
    if ids is not None:
        df = df.where(F.col(key).isin(list(ids)) if ids else F.lit(False))
    return df.where(~F.col(key).isin(list(exclude))) if exclude else df


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of ``batch`` to append: keys complete, first of their key, not in ``target``."""
    whole = batch.dropna(subset=list(keys))
    return keep_first(whole, keys, order).join(target.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``target`` after an unconditional upsert of the first row per key of ``batch``."""
    fresh = keep_first(batch, keys, order)
    return target.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def conditional_upsert(target: DataFrame, batch: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """One row per key of either side with ``action``: insert, update (a compared column differs,
    nulls being equal), unchanged, or keep (not in the batch), and the values after it."""
    t = target.select(key, F.struct(*[c for c in target.columns if c != key]).alias("t"))
    b = batch.select(key, F.struct(*[c for c in target.columns if c != key]).alias("b"))
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}"))
    action = (
        F.when(F.col("t").isNull(), "insert").when(F.col("b").isNull(), "keep").when(differs, "update").otherwise("unchanged")
    )
    j = t.join(b, key, "full_outer").withColumn("action", action)
    after = F.when(F.col("action").isin("insert", "update"), F.col("b")).otherwise(F.col("t"))
    return j.withColumn("after", after).select(key, "action", "after.*")


def sync_plan(target: DataFrame, stage: DataFrame, key: str, delete_stale: bool = True) -> DataFrame:
    """Table synchronisation by full-outer diff: insert, update, unchanged, and delete or stale."""
    cols = [c for c in target.columns if c != key]
    t = target.select(key, F.struct(*cols).alias("t"))
    s = stage.select(key, F.struct(*cols).alias("s"))
    action = (
        F.when(F.col("t").isNull(), "insert")
        .when(F.col("s").isNull(), "delete" if delete_stale else "stale")
        .when(F.col("t").eqNullSafe(F.col("s")), "unchanged")
        .otherwise("update")
    )
    return t.join(s, key, "full_outer").select(key, action.alias("action"))


def hash_sync_plan(target: DataFrame, source: DataFrame, key: str, vector: str, metadata: str, delete_stale: bool = True) -> DataFrame:
    """Vector-store plan by two hashes: insert, vector_update, metadata_update, unchanged, stale."""
    t = target.select(key, F.col(vector).alias("tv"), F.col(metadata).alias("tm"), F.lit(True).alias("in_t"))
    s = source.select(key, F.col(vector).alias("sv"), F.col(metadata).alias("sm"), F.lit(True).alias("in_s"))
    action = (
        F.when(F.col("in_t").isNull(), "insert")
        .when(F.col("in_s").isNull(), "delete" if delete_stale else "stale")
        .when(~F.col("tv").eqNullSafe(F.col("sv")), "vector_update")
        .when(~F.col("tm").eqNullSafe(F.col("sm")), "metadata_update")
        .otherwise("unchanged")
    )
    return t.join(s, key, "full_outer").select(key, action.alias("action"))


def assemble_states(
    left: DataFrame, right: DataFrame, key: str, left_cols: Sequence[str], right_cols: Sequence[str], right_order: Sequence[Column] = ()
) -> DataFrame:
    """State join: a row of ``left`` whose key is unique there meets the last row of ``right`` with
    its key; rows of repeated left keys stay alone, and all other right rows are appended."""
    n = F.count("*").over(Window.partitionBy(key))
    lefts = left.select(key, *left_cols, (n == 1).alias("_single"))
    single = lefts.where("_single").drop("_single")
    rights = right.select(key, *right_cols)
    order = list(right_order) or [F.col(c).desc_nulls_last() for c in right_cols]
    matched = single.join(keep_first(rights, [key], order), key, "left")
    rest = rights.join(single.select(key), key, "left_anti")
    repeated = lefts.where("NOT _single").drop("_single")
    return matched.unionByName(repeated, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that fails if either side repeats a key."""
    for name, side in (("left", left), ("right", right)):
        if not unique_violations(side, keys).isEmpty():
            raise ValueError(f"the {name} side repeats a key")
    return left.join(right, list(keys), "left")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (1-based) of an ordered result, with the total on every row."""
    total = df.agg(F.count("*").alias("total"))  # one row; the others never meet for it
    return df.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def prefix_before_seen(df: DataFrame, position: str, seen: Column, limit: int) -> DataFrame:
    """Rows before the first one already seen, at most ``limit`` of them."""
    first = df.where(seen).agg(F.min(position).alias("_first"))
    return df.join(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(position) < F.col("_first"))).drop("_first").orderBy(position).limit(limit)


def running_share(df: DataFrame, count: str, label: str) -> DataFrame:
    """Share and cumulative share, by count descending, then label."""
    d = running(with_total(df, _total=F.sum(count)), [F.col(count).desc(), F.col(label)], {"_run": count})
    return d.withColumn("share", F.col(count) / F.col("_total")).withColumn("cum_share", F.col("_run") / F.col("_total")).drop("_run", "_total")


def grouped_offsets(df: DataFrame, order: str, count: str) -> DataFrame:
    """Each group's offset: the running sum of the counts before it."""
    return running(df, [order], {"offset": count}).withColumn("offset", F.col("offset") - F.col(count))
