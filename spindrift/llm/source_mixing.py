"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Targets: each source gets its weight's share of all words; a target stops at ``max_epochs`` times
its source's size and the excess goes to the others by weight, until none is above its cap.  The
rounds end when nothing changes.  Sums stay integers (decimals where they multiply), so a rerun
gives the same doubles.

Sampling: every document is taken ``floor(target / size)`` whole times; the fractional repetition
goes to documents in the order of a seeded hash until the source's target is met (the document
that crosses it is taken if that comes nearer).  The running sum is two-level, over hash buckets
and then inside the bucket where it ends, so no source, however hot, meets in one task, and the
result is one key per source: documents are taken by a comparison in the scan, not by a shuffle.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; sources
without words get target 0 and nothing is taken; an empty table gives an empty result; rows that
repeat a doc_id are sampled each on its own, equal rows alike.  ``mixed`` keeps all columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import apart, cut, word_count

SEED = "mix-1"
#: Hash buckets per source for the two-level running sum; 3 hexadecimal digits.
BUCKET_DIGITS = 3
#: A plan of so many bytes at most is broadcast; beyond, it is joined by its source.
PLAN_BYTES = 8 << 20


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank, their place from 0 by code point, null last.  Rows are dealt in
    ranges and numbered inside a range, so many sources don't meet in one task."""
    order = (F.col("source").isNull(), F.col("source"))
    s = cut(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = s.groupBy("range").agg(F.count("*").alias("n"))  # a row a partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return s.withColumn("n1", place).join(F.broadcast(counts), "range").withColumn("rank", F.col("n0") + F.col("n1") - 1).drop("range", "n0", "n1")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with target double.

    Weights repeat over the sources by code point, null last.  Every round shares what the capped
    sources leave among the others by weight and caps those that it lifts above their cap, until
    none is; a round is one aggregate over the sources, and its state two whole numbers.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    s = ranked(sources.select("source", "source_size")).withColumn("weight", pick.cast("long"))
    s = cut(s.withColumn("cap", F.col("source_size") * max_epochs))
    every = s.agg(F.sum("source_size").alias("b"), F.sum("weight").alias("w")).first()
    total, weight = int(every["b"] or 0), int(every["w"] or 0)
    left, w_left, capped = total, weight, F.lit(False)
    while w_left:
        capped = dec(F.col("cap")) * dec(F.lit(w_left)) <= dec(F.col("weight")) * dec(F.lit(left))
        full = s.where(capped).agg(F.sum("cap").alias("b"), F.sum("weight").alias("w")).first()
        after = total - int(full["b"] or 0), weight - int(full["w"] or 0)
        if after == (left, w_left):
            break
        left, w_left = after
    if not w_left:
        return s.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(w_left))
    return s.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _key(seed: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The seeded order: by id and text, so a rerun agrees where ids repeat."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))
    return F.md5(F.concat_ws(":", F.lit(seed), own, F.md5(F.coalesce(F.col(text), F.lit("")))))


def _named(source: str = "source") -> list[Column]:
    return [F.col(source).isNull().alias("no_src"), F.coalesce(source, F.lit("")).alias("src")]


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, no_src, src, size and key of every document: the one pass over the texts."""
    return cut(docs.select("doc_id", *_named(), word_count(F.col("text")).alias("size"), _key(seed).alias("key")))


def plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """For each source of ``rows`` (no_src, src, size, key): source_size, target, times (whole
    repetitions) and last, the greatest key that is taken once more (empty: none).

    Keys are taken in order while their middle lies below what is still needed, so they end at one
    key; only the bucket of keys in which it lies is put in order.
    """
    r = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    cells = r.groupBy("no_src", "src", "bucket").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("no_src", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("no_src", "src")
    cells = cut(
        cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
        .withColumn("source_size", F.sum("cell_size").over(whole))
    )
    sizes = cells.groupBy("no_src", "src").agg(F.max("source_size").alias("source_size"))
    targets = water_fill(sizes.select(F.when(~F.col("no_src"), F.col("src")).alias("source"), "source_size"), weights, max_epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.select(*_named(), "source_size", "target", times.alias("times"))
    targets = cut(targets.withColumn("need", F.col("target") - F.col("times") * F.col("source_size")))
    at = cells.drop("source_size").join(apart(targets, "src"), ["no_src", "src"]).where("cell_before < need")
    at = at.groupBy("no_src", "src").agg(F.max("bucket").alias("bucket"), F.max("cell_before").alias("cell_before"), F.max("need").alias("need"))
    inside = Window.partitionBy("no_src", "src").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = r.where("size > 0").join(apart(at, "src"), ["no_src", "src", "bucket"])
    edge = edge.withColumn("sum_before", F.col("cell_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = edge.where(F.col("need") - F.col("sum_before") >= F.col("size") / 2).groupBy("no_src", "src").agg(F.max("key").alias("key"))
    at = at.join(taken, ["no_src", "src"], "left").select("no_src", "src", F.coalesce("key", "bucket").alias("last"))
    return targets.join(at, ["no_src", "src"], "left").select("no_src", "src", "source_size", "target", "times", F.coalesce("last", F.lit("")).alias("last"))


def _with_plan(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and copies.  The plan is broadcast if it is small."""
    plan_ = cut(plan_)
    few = (plan_.agg(F.sum(F.octet_length("src") + 100)).first()[0] or 0) <= PLAN_BYTES
    joined = rows.join(F.broadcast(plan_) if few else apart(plan_, "src"), ["no_src", "src"])
    return joined.withColumn("copies", F.col("times") + F.when((F.col("size") > 0) & (F.col("key") <= F.col("last")), 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the document is taken) and taken;
    ``docs`` needs doc_id, text and source."""
    rows = sized(docs, seed)
    d = _with_plan(rows, plan(rows, weights, max_epochs))
    return d.select(
        "doc_id", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.  The texts are read
    once for their sizes and once for the result, and stay where they are unless sources are many."""
    chosen = plan(sized(docs, seed), weights, max_epochs)
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(
        F.struct("*").alias("_row"), *_named(), F.coalesce(some, F.lit(False)).cast("int").alias("size"), _key(seed).alias("key")
    )
    taken = _with_plan(rows, chosen).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def mixing_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS key FROM documents
),
s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source
),
s1 AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS w_all,
    coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS w_before
  FROM s0 WINDOW o AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
s2 AS (SELECT *, cap * (w_all - w_before) <= weight * (total - cap_before) AS capped FROM s1),
s3 AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
      / CAST(w_all - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS DOUBLE) END AS target FROM s2
),
r AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source
)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN size > 0
  AND target - times * source_size - before >= size / 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
