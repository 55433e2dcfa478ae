"""Sample sizes, quotas, seeded takes and the epoch mix sampler."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.order import numbered, running, with_total


def take_target(spec: int | float | None, n: int) -> int:
    """Rows that a take spec means: an int counts, a float below 1 is a fraction, 1.0 or None is
    all, 0 or less is none."""
    if spec is None:
        return n
    if isinstance(spec, float):
        return n if spec >= 1.0 else max(0, int(n * spec))
    return min(n, max(0, spec))


def seeded_take(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same rows on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def largest_remainder(df: DataFrame, weight: str, total: int, order: str) -> DataFrame:
    """Whole quotas that sum to ``total``: floors, then one each by remainder, then ``order``."""
    d = with_total(df, _w=F.sum(weight)).withColumn("_x", F.round(F.lit(total) * F.col(weight) / F.col("_w"), 9)).withColumn("_f", F.floor("_x"))
    d = numbered(with_total(d, _sum=F.sum("_f")), [(F.col("_x") - F.col("_f")).desc(), F.col(order)], "_rank", 1)
    quota = F.col("_f") + F.when(F.col("_rank") <= total - F.col("_sum"), 1).otherwise(0)
    return d.withColumn("quota", quota.cast("long")).drop("_x", "_f", "_w", "_sum", "_rank")


def allocate(clusters: DataFrame, cluster: str, size: str, num: int, cap: int, growth: str = "log") -> DataFrame:
    """Picks per cluster that sum to ``num`` unless caps and sizes forbid it.

    One each, the rest by largest remainder on log1p or sqrt of the size (equal remainders go to
    the lesser cluster), cut to cap and size; what the cut leaves goes to clusters with room, the
    largest first.  Fewer picks than clusters go to the clusters of least hash.
    """
    c = clusters.where(F.col(size) > 0).select(cluster, size, F.least(F.col(size), F.lit(cap)).alias("_room"))
    weight = F.log1p(size) if growth == "log" else F.sqrt(size)
    c = with_total(c.withColumn("_w", weight), _n=F.count("*"), _all=F.sum("_w"))
    extra = F.greatest(F.lit(num) - F.col("_n"), F.lit(0))
    c = c.withColumn("_x", F.round(extra * F.col("_w") / F.col("_all"), 9)).withColumn("_f", F.floor("_x"))
    c = numbered(with_total(c, _sum=F.sum("_f")), [(F.col("_x") - F.col("_f")).desc(), F.col(cluster)], "_rest", 1)
    one_more = F.when(F.col("_rest") <= extra - F.col("_sum"), 1).otherwise(0)
    c = c.withColumn("_k", F.least(1 + F.col("_f") + one_more, F.col("_room"))).withColumn("_head", F.col("_room") - F.col("_k"))
    c = running(with_total(c, _given=F.sum("_k")), [F.col(size).desc(), F.col(cluster)], {"_upto": "_head"})
    need = F.lit(num) - F.col("_given")
    fill = F.least(F.col("_head"), F.greatest(need - (F.col("_upto") - F.col("_head")), F.lit(0)))
    c = numbered(c, [F.md5(F.col(cluster).cast("string")), F.col(cluster)], "_few", 1)
    k = F.when(F.col("_n") > num, F.when(F.col("_few") <= num, 1).otherwise(0)).otherwise(F.col("_k") + fill)
    return c.select(cluster, size, k.cast("long").alias("k"))


def epoch_sample(pool: DataFrame, source: str, item: str, usage: str, quotas: Mapping[str, int], seed: str) -> DataFrame:
    """One epoch: from each source its quota, least-used items first, seeded ties.

    Each item stands at its usage, usage + 1, …: a quota beyond the pool takes items again.
    """
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(source) == name, F.lit(n)).otherwise(quota)
    size = F.count("*").over(Window.partitionBy(source))
    p = pool.withColumn("_q", quota).withColumn("_c", F.ceil(F.col("_q") / size).cast("int")).where("_c > 0")
    spread = F.max(usage).over(Window.partitionBy(source)) - F.min(usage).over(Window.partitionBy(source))
    p = p.withColumn("_s", spread.cast("int"))
    p = p.withColumn("level", F.explode(F.sequence(F.col(usage), F.col(usage) + F.col("_c") + F.col("_s"))))
    tie = F.md5(F.concat_ws(":", F.lit(seed), F.col(source), F.col(item).cast("string")))
    w = Window.partitionBy(source).orderBy("level", tie, item)
    return p.withColumn("_r", F.row_number().over(w)).where("_r <= _q").select(source, item, "level")


def rank_shard(df: DataFrame, position: str, rank: int, world: int) -> DataFrame:
    """Every ``world``-th row from ``rank``."""
    return df.where(F.pmod(F.col(position), F.lit(world)) == rank)
