"""Queries on time ranges, window frames, sketches, and parameters by corpus size."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import ranges as G
from spindrift.operators import retrieval as Q
from spindrift.operators import tuning
from spindrift.plans.registry import query
from spindrift.sources.tables import table

HOUR = 3_600_000_000


def timed(s, d, kind):
    e = table(s, d, "events").where(F.col("event_type") == kind)
    return e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "value")


@query("as_of_join", """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us, value FROM events), v AS (SELECT * FROM e WHERE event_type = 'view'), c AS (SELECT * FROM e WHERE event_type = 'click')
SELECT event_id, user_id, at_us, seen, coalesce(seen_at, -1) AS seen_at FROM (SELECT c.event_id, c.user_id, c.at_us, v.value AS seen, v.at_us AS seen_at, row_number() OVER (PARTITION BY c.event_id ORDER BY v.at_us DESC NULLS LAST, v.event_id DESC) AS rn
FROM c LEFT JOIN v ON c.user_id = v.user_id AND v.at_us <= c.at_us) WHERE rn = 1""")
def as_of_join(s, d):
    """Each click with the user's last view at or before it."""
    views = timed(s, d, "view").withColumnRenamed("value", "seen")
    j = G.as_of(timed(s, d, "click").drop("value"), views, ["user_id"], "at_us", "seen", 24 * HOUR, "event_id")
    return j.withColumn("seen_at", F.coalesce("seen_at", F.lit(-1)))


@query("interval_join", f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us FROM events) SELECT c.event_id, v.event_id AS span_id FROM e c JOIN e v
ON c.user_id = v.user_id AND c.at_us >= v.at_us AND c.at_us < v.at_us + {24 * HOUR} WHERE c.event_type = 'click' AND v.event_type = 'view'""")
def interval_join(s, d):
    """Clicks within a day from a view of the same user."""
    spans = timed(s, d, "view").select(F.col("event_id").alias("span_id"), "user_id", F.col("at_us").alias("begins"), (F.col("at_us") + 24 * HOUR).alias("ends"))
    return G.in_intervals(timed(s, d, "click"), spans, ["user_id"], "at_us", "begins", "ends", 24 * HOUR).select("event_id", "span_id")


@query("distinct_sketch", """SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, true AS sketch_near, true AS union_near FROM events GROUP BY 1""")
def distinct_sketch(s, d):
    """Distinct users per type, exactly and by a sketch; sketches of the days add up to the same."""
    e = table(s, d, "events")
    day = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("sketch"))
    union = day.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("by_day"))
    whole = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("sketched"))
    near = lambda c: F.abs(F.col(c) - F.col("users")) <= F.greatest(F.lit(2.0), 0.1 * F.col("users"))
    return whole.join(union, "event_type").select("event_type", "users", near("sketched").alias("sketch_near"), near("by_day").alias("union_near"))


@query("window_frames", """SELECT o_orderkey, CAST(dense_rank() OVER p AS BIGINT) AS dense, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(percent_rank() OVER p, 9) AS percent,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) // 86400 RANGE BETWEEN 90 PRECEDING AND CURRENT ROW), 2) AS last_90_days
FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderpriority), w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(s, d):
    o = table(s, d, "orders").withColumn("day", F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400))
    by = Window.partitionBy("o_custkey")
    rank, order = by.orderBy("o_orderpriority"), by.orderBy("o_orderdate", "o_orderkey")
    spent = F.sum("o_totalprice").over(by.orderBy("day").rangeBetween(-90, 0))
    return o.select(
        "o_orderkey", F.dense_rank().over(rank).cast("long").alias("dense"), F.ntile(4).over(order).cast("long").alias("quarter"),
        F.round(F.percent_rank().over(rank), 9).alias("percent"), F.round(spent, 2).alias("last_90_days"),
    )


@query("index_parameters", """WITH c AS (SELECT 'source ' || source AS corpus, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'region ' || r_name, count(*) FROM region GROUP BY r_name),
t AS (SELECT *, CASE WHEN n < 200 THEN least(n - 1, 256) WHEN n < 1500 THEN least(n - 1, 2048) WHEN n < 10000 THEN least(n - 1, 6144) ELSE least(n - 1, 8192) END AS h,
CASE WHEN n < 200 THEN ceil(0.6::DOUBLE * n) WHEN n < 1500 THEN greatest(128, ceil(0.5::DOUBLE * n)) WHEN n < 10000 THEN greatest(1024, ceil(0.4::DOUBLE * n)) ELSE greatest(2048, ceil(0.12::DOUBLE * n)) END AS l FROM c),
k AS (SELECT *, CASE WHEN n <= 2 THEN greatest(1, n - 1) ELSE greatest(greatest(2, least(h, n - 1)), greatest(2, least(l, n - 1))) END AS top FROM t)
SELECT corpus, n, CAST(top AS BIGINT) AS top_k,
CAST(CASE WHEN n <= 2 THEN 1 ELSE greatest(1, least(CASE WHEN n < 200 THEN least(h, 64) WHEN n < 1500 THEN least(h, 256) WHEN n < 10000 THEN least(1024, round_even(0.3::DOUBLE * h, 0)) ELSE least(1024, ceil(0.25::DOUBLE * h)) END, top - 1)) END AS BIGINT) AS max_edges_per_node,
CAST(CASE WHEN n <= 2 THEN 1 ELSE greatest(1, least(CASE WHEN n < 200 THEN least(h, 32) WHEN n < 1500 THEN least(h, 128) WHEN n < 10000 THEN least(512, round_even(0.15::DOUBLE * h, 0)) ELSE least(512, ceil(0.12::DOUBLE * h)) END, top - 1)) END AS BIGINT) AS attach_neigh_k,
CAST(CASE WHEN n <= 2 THEN 1 ELSE greatest(1, least(CASE WHEN n < 200 THEN h WHEN n < 1500 THEN least(h, 512) WHEN n < 10000 THEN least(2048, floor(0.35::DOUBLE * h)) ELSE least(2048, ceil(0.3::DOUBLE * h)) END, top - 1)) END AS BIGINT) AS pair_k,
CAST(CASE WHEN n <= 2 THEN greatest(1, n - 1) ELSE greatest(top, least(n - 1, CASE WHEN n < 200 OR n >= 10000 THEN 2 * h ELSE n - 1 END)) END AS BIGINT) AS ef_search,
CAST(CASE WHEN n <= 2 THEN 2 ELSE greatest(1, least(n - 1, CASE WHEN n < 200 THEN greatest(64, 4 * h) WHEN n < 1500 THEN greatest(128, least(512, round_even(0.4::DOUBLE * h, 0))) WHEN n < 10000 THEN least(2048, round_even(0.5::DOUBLE * h, 0)) ELSE least(512, ceil(0.15::DOUBLE * h)) END)) END AS BIGINT) AS ef_construction FROM k""")
def index_parameters(s, d):
    """High-side parameters for corpora of many sizes."""
    one = lambda t, name: table(s, d, t).agg(F.lit(name).alias("corpus"), F.count("*").alias("n"))
    each = lambda t, word, c: table(s, d, t).groupBy(F.concat(F.lit(word), F.col(c)).alias("corpus")).agg(F.count("*").alias("n"))
    c = each("documents", "source ", "source").unionAll(one("embeddings", "vectors")).unionAll(one("orders", "orders"))
    c = c.unionAll(one("events", "events")).unionAll(each("region", "region ", "r_name"))
    p = c.withColumn("p", tuning.recommended(F.col("n"), "max"))
    return p.select("corpus", "n", *(F.col(f"p.{k}") for k in ("top_k", "max_edges_per_node", "attach_neigh_k", "pair_k", "ef_search", "ef_construction")))


@query("claim_failures", """SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty claim' ELSE 'no vector' END AS error FROM documents LEFT JOIN embeddings ON doc_id = vec_id
WHERE trim(coalesce(text, '')) = '' OR embedding IS NULL""")
def claim_failures(s, d):
    """Documents that can't be searched as claims, each with its reason."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    jobs = table(s, d, "documents").select("doc_id", "text").join(e, "doc_id", "left")
    return Q.checked_jobs(jobs, "text", "embedding", 64).where("error IS NOT NULL").select("doc_id", "error")
