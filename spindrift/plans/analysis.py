"""Joins and aggregates, evaluation roll-ups, judge state, retrieval and feature queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import parsing as P
from spindrift.functions import scalars as S
from spindrift.functions import text as T
from spindrift.operators import features as X
from spindrift.operators import relational as R
from spindrift.operators import retrieval as Q
from spindrift.operators import search as K
from spindrift.operators.blocks import met
from spindrift.operators.order import numbered
from spindrift.plans.registry import query
from spindrift.plans.text_queries import SENTENCES
from spindrift.sources.tables import table


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(s, d):
    li = table(s, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("three_way_join", """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def three_way(s, d):
    c = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_join_predicate", """SELECT c_custkey, count(o_orderkey) AS finished FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def left_join_predicate(s, d):
    done = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(s, d, "customer").select("c_custkey").join(done, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("finished"))


@query("value_counts_with_null", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def value_counts(s, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    g = table(s, d, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return g.select(F.coalesce("status", F.lit("none")).alias("status"), "n")


@query("distinct_combinations", "SELECT count(DISTINCT p_brand || p_type) AS combos, count(DISTINCT p_brand) AS brands FROM part")
def distinct_combos(s, d):
    return table(s, d, "part").agg(F.count_distinct(F.concat("p_brand", "p_type")).alias("combos"), F.count_distinct("p_brand").alias("brands"))


@query("flags_by_task", "SELECT event_type AS task, count(*) AS n, CAST(sum(CAST(value > 50 AS INTEGER)) AS BIGINT) AS hits, round(avg(CAST(value > 50 AS INTEGER)), 9) AS rate FROM events GROUP BY 1")
def flags_by_task(s, d):
    hit = (F.col("value") > 50).cast("int")
    return table(s, d, "events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 9).alias("rate"))


@query("price_cube", """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def price_cube(s, d):
    g = table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


METRICS = """
m AS (SELECT user_id % 6 AS model, event_type AS metric, avg(value) AS v FROM events GROUP BY 1, 2),
w AS (SELECT model, round(max(v) FILTER (WHERE metric = 'click'), 6) AS click, round(max(v) FILTER (WHERE metric = 'view'), 6) AS view_, round(max(v) FILTER (WHERE metric = 'purchase'), 6) AS purchase FROM m GROUP BY model)
"""


def model_metrics(s, d):
    m = table(s, d, "events").groupBy((F.col("user_id") % 6).alias("model")).pivot("event_type", ["click", "view", "purchase"]).agg(F.avg("value"))
    return m.select("model", F.round("click", 6).alias("click"), F.round("view", 6).alias("view_"), F.round("purchase", 6).alias("purchase"))


@query("metrics_pivot_delta", f"""WITH {METRICS}, c AS (SELECT *, round(0.5 * click + 0.5 * (0.5 * view_ + 0.5 * purchase), 5) AS combo FROM w)
SELECT model, click, view_, purchase, combo, round(combo - (SELECT combo FROM c WHERE model = 0), 4) AS delta FROM c""")
def metrics_pivot(s, d):
    w = model_metrics(s, d).withColumn("combo", F.round(0.5 * F.col("click") + 0.5 * (0.5 * F.col("view_") + 0.5 * F.col("purchase")), 5))
    base = F.max(F.when(F.col("model") == 0, F.col("combo"))).over(Window.partitionBy())
    return w.withColumn("delta", F.round(F.col("combo") - base, 4))


@query("select_best", f"""WITH {METRICS} SELECT model, click FROM w WHERE model <> 0 ORDER BY click DESC, model LIMIT 1""")
def select_best(s, d):
    """The best model by validation score alone; the base and non-finite scores don't count."""
    w = model_metrics(s, d).where((F.col("model") != 0) & F.col("click").isNotNull() & ~F.isnan("click"))
    return w.orderBy(F.col("click").desc(), "model").limit(1).select("model", "click")


PAIRS = "p AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS a, (o_totalprice * (1 + ((o_orderkey % 5) - 2) / 10.0::DOUBLE)) / 500000 AS b, o_orderstatus AS flag FROM orders)"


def scored_pairs(s, d):
    o = table(s, d, "orders")
    factor = 1 + ((F.col("o_orderkey") % 5) - 2) / F.lit(10.0)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("a"), ((F.col("o_totalprice") * factor) / 500000).alias("b"), F.col("o_orderstatus").alias("flag"))


@query("improved_worsened", f"""WITH {PAIRS} SELECT flag, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(*) FILTER (WHERE b - a > 1e-9) AS improved, count(*) FILTER (WHERE b - a < -1e-9) AS worsened,
count(*) FILTER (WHERE abs(b - a) <= 1e-9) AS same, count(*) FILTER (WHERE a < 0.5) AS below_half, round(avg((1 - a) - (1 - b)), 6) AS hallucination_drop FROM p GROUP BY flag""")
def improved_worsened(s, d):
    up = F.col("b") - F.col("a")
    return scored_pairs(s, d).groupBy("flag").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.count_if(up > 1e-9).alias("improved"),
        F.count_if(up < -1e-9).alias("worsened"), F.count_if(F.abs(up) <= 1e-9).alias("same"), F.count_if(F.col("a") < 0.5).alias("below_half"),
        F.round(F.avg((1 - F.col("a")) - (1 - F.col("b"))), 6).alias("hallucination_drop"),
    )


@query("top_improvements", f"WITH {PAIRS} SELECT id, round(b - a, 9) AS delta FROM p ORDER BY round(b - a, 9) DESC, id LIMIT 10")
def top_improvements(s, d):
    return scored_pairs(s, d).select("id", F.round(F.col("b") - F.col("a"), 9).alias("delta")).orderBy(F.col("delta").desc(), "id").limit(10)


@query("run_rows", f"WITH {PAIRS} SELECT id FROM p WHERE abs(b - a) > 1e-9 ORDER BY flag, id LIMIT 50 OFFSET 10")
def run_rows(s, d):
    return scored_pairs(s, d).where(F.abs(F.col("b") - F.col("a")) > 1e-9).orderBy("flag", "id").offset(10).limit(50).select("id")


@query("score_reuse", f"WITH {PAIRS}, t AS (SELECT DISTINCT flag, CAST(floor(a * 100) AS BIGINT) AS k FROM p) SELECT count(*) AS scored, (SELECT count(*) FROM p) AS requested FROM t")
def score_reuse(s, d):
    """How many distinct inputs a scorer must see, against how many rows ask."""
    p = scored_pairs(s, d).select("flag", F.floor(F.col("a") * 100).alias("k"))
    return p.groupBy("flag", "k").agg(F.count("*").alias("n")).agg(F.count("*").alias("scored"), F.sum("n").alias("requested"))


@query("best_so_far", """SELECT event_id, user_id, value, CAST(rank AS BIGINT) AS rank FROM (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE value IS NOT NULL) WHERE rank <= 2""")
def best_so_far(s, d):
    e = table(s, d, "events").where("value IS NOT NULL")
    return R.top_per_group(e, ["user_id"], [F.col("value").desc(), F.col("event_id")], 2).select("event_id", "user_id", "value", F.col("rank").cast("long").alias("rank"))


@query("latest_before", """SELECT event_id, latest FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS latest FROM events) WHERE event_type = 'purchase' AND latest IS NOT NULL""")
def latest_before(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(s, d, "events").withColumn("latest", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase' AND latest IS NOT NULL").select("event_id", "latest")


@query("event_windows", """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(s, d):
    h = F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH:mm")
    return table(s, d, "events").groupBy(h.alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("set_differences", """SELECT 'missing' AS side, o_custkey AS id FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
UNION ALL SELECT 'both', c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)""")
def set_differences(s, d):
    o = table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")).distinct()
    c = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return o.exceptAll(c).select(F.lit("missing").alias("side"), "id").unionAll(c.intersect(o).select(F.lit("both").alias("side"), "id"))


@query("array_overlap", """SELECT a.user_id AS u, b.user_id AS v FROM (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE event_id % 7 = 0 GROUP BY 1) a JOIN (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE event_id % 11 = 0 GROUP BY 1) b
ON a.user_id % 10 = b.user_id % 10 WHERE len(list_intersect(a.l, b.l)) > 0""")
def array_overlap(s, d):
    """Users with the same types lie in blocks, blocks are compared, and pairs are written out only then."""
    e = table(s, d, "events")
    one = lambda m: e.where(f"event_id % {m} = 0").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    parts = max(1, e.select("user_id").distinct().count() // 10_000)

    def blocked(m, k, types, ids):
        keys = [(F.col("user_id") % 10).alias(k), F.col("types").alias(types), F.pmod(F.xxhash64("user_id"), F.lit(parts)).alias("part")]
        return one(m).groupBy(*keys).agg(F.collect_list("user_id").alias(ids)).drop("part")

    pairs = met(blocked(11, "k2", "b", "vs").repartition(8), blocked(7, "k1", "a", "us").repartition(48))
    pairs = pairs.where(F.col("k1") == F.col("k2")).where(F.arrays_overlap("a", "b"))
    return pairs.select(F.explode("us").alias("u"), "vs").select("u", F.explode("vs").alias("v"))


@query("stable_rank_fallback", """SELECT p_partkey, row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 3 = 1 THEN p_size * 10 END, 1e300), p_partkey) AS pos FROM part""")
def stable_rank(s, d):
    key = F.coalesce(F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")), F.when(F.col("p_size") % 3 == 1, (F.col("p_size") * 10).cast("double")), F.lit(float("inf")))
    return numbered(table(s, d, "part").select("p_partkey", key.alias("key")), ["key", "p_partkey"], "pos", 1).drop("key")


@query("rank_change", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) SELECT o_orderkey, a - b AS change FROM r WHERE a <= 3""")
def rank_change(s, d):
    w = Window.partitionBy("o_custkey")
    r = table(s, d, "orders").select(
        "o_orderkey", F.row_number().over(w.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("a"),
        F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("b"),
    )
    return r.where("a <= 3").select("o_orderkey", (F.col("a") - F.col("b")).alias("change"))


@query("job_order", """SELECT conv_id, turn, row_number() OVER (ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, conv_id, turn) AS pos FROM conversations""")
def job_order(s, d):
    p = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return numbered(table(s, d, "conversations").select("conv_id", "turn", p.alias("p")), ["p", "conv_id", "turn"], "pos", 1).drop("p")


@query("quality_states", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'PARSE_FAILED' WHEN quality = 0 THEN 'REVISED' ELSE 'OK' END AS final_status, quality = 0 AS changed FROM labels""")
def quality_states(s, d):
    final = F.when(F.col("toxic") == 1, "PARSE_FAILED").when(F.col("quality") == 0, "REVISED").otherwise("OK")
    return table(s, d, "labels").select("doc_id", final.alias("final_status"), (F.col("quality") == 0).alias("changed"))


@query("stage_one_routes", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'PASS' ELSE 'VERIFY' END AS status, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'category' WHEN 2 THEN 'both' ELSE 'both' END AS route, p_size % 4 <> 2 AS ok FROM part""")
def stage_one(s, d):
    k = F.col("p_size") % 4
    raw = F.when(k == 0, "<think>x\ny</think>PASS").when(k == 1, "verify\nRoute: Category").when(k == 2, "VERIFY\nno route").otherwise("verify\n route : both")
    return table(s, d, "part").select("p_partkey", P.stage_one(raw).alias("r")).select("p_partkey", "r.status", "r.route", "r.ok")


@query("neighbour_context", r"""WITH t AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, coalesce(left(lag(text) OVER w, 15), '') AS before, coalesce(left(lead(text) OVER w, 15), '') AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    cut = lambda c: F.coalesce(F.left(c, F.lit(15)), F.lit(""))
    return table(s, d, "conversations").select("conv_id", "turn", cut(F.lag("text").over(w)).alias("before"), cut(F.lead("text").over(w)).alias("after"))


TERMS = r"""
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
dc AS (SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS len FROM dt GROUP BY doc_id, term),
st AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS al FROM documents),
df AS (SELECT term, count(*) AS df FROM dc GROUP BY term),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM qt JOIN df USING (term) JOIN dc USING (term), st GROUP BY item_id, doc_id)
"""


@query("bm25_topk", f"WITH {TERMS} SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, doc_id) AS rn FROM bm) WHERE rn <= 5")
def bm25_topk(s, d):
    found = K.bm25_top(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text", 5)
    return found.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "score")


VEC = """
v AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id AND b.label = a.label),
kw AS (SELECT q, doc, CAST((q + doc) % 17 AS DOUBLE) AS score FROM v WHERE doc % 2 = 0),
vs AS (SELECT q, doc, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1.0 END AS x FROM v WINDOW p AS (PARTITION BY q)),
ks AS (SELECT q, doc, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1.0 END AS x FROM kw WINDOW p AS (PARTITION BY q)),
h AS (SELECT q, doc, round(0.7 * coalesce(vs.x, 0) + 0.3 * coalesce(ks.x, 0), 9) AS score FROM vs FULL JOIN ks USING (q, doc)),
hr AS (SELECT q, doc, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM h)
"""


def vector_scores(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "label", F.col("embedding").alias("qe"))
    j = q.join(e.withColumnRenamed("vec_id", "doc"), "label").where("q <> doc")
    return j.select("q", "doc", F.round(S.dot(F.col("qe"), F.col("embedding")), 9).alias("score"))


def hybrid_scores(s, d):
    v = vector_scores(s, d)
    kw = v.where("doc % 2 = 0").select("q", "doc", ((F.col("q") + F.col("doc")) % 17).cast("double").alias("score"))
    return Q.hybrid(v, kw, "q", "doc", 0.7, 8, None)


@query("hybrid_search", f"WITH {VEC} SELECT q, doc, round(score, 6) AS score, rank FROM hr WHERE rank <= 8")
def hybrid_search(s, d):
    return hybrid_scores(s, d).select("q", "doc", F.round("score", 6).alias("score"), "rank")


@query("confident_topics", f"WITH {VEC} SELECT q, count(*) AS n, round(max(score), 6) AS best FROM hr WHERE rank <= 8 AND score >= 0.52 GROUP BY q")
def confident_topics(s, d):
    return Q.confident(hybrid_scores(s, d), "score", 0.52).groupBy("q").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("recommendation_records", f"WITH {VEC} SELECT e.vec_id AS q, coalesce((SELECT string_agg(CAST(doc AS VARCHAR), ',' ORDER BY rank) FROM hr WHERE hr.q = e.vec_id AND rank <= 5), '') AS ids FROM embeddings e WHERE e.vec_id % 50 = 0")
def recommendation_records(s, d):
    queries = table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"))
    r = Q.recommendation_records(queries, hybrid_scores(s, d), "q", "doc", [F.col("rank")], 5)
    return r.select("q", F.array_join(F.transform("recommended", lambda x: x.cast("string")), ",").alias("ids"))


@query("evidence_packets", f"""WITH {VEC}, c AS (SELECT vec_id AS q, unnest([1, 2, 3]) AS claim_idx FROM embeddings WHERE vec_id % 50 = 0)
SELECT q, string_agg(claim_idx || ':' || coalesce((SELECT string_agg(CAST(doc AS VARCHAR), ',' ORDER BY rank) FROM hr WHERE hr.q = c.q AND rank <= 2 AND claim_idx <> 2), ''), ';' ORDER BY claim_idx) AS packet FROM c GROUP BY q""")
def evidence_packets(s, d):
    ids = table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"))
    claims = ids.select("q", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))).alias("claim_idx")).withColumn("claim", F.lit("c"))
    found = hybrid_scores(s, d).crossJoin(s.createDataFrame([(1,), (3,)], "claim_idx long"))
    p = Q.evidence_packets(claims, found, "q", 2)
    text = F.transform("claims", lambda c: F.concat(c["claim_idx"].cast("string"), F.lit(":"), F.array_join(F.transform(c["evidence"], lambda e: e["doc"].cast("string")), ",")))
    return p.select("q", F.array_join(text, ";").alias("packet"))


def whole_scores(s, d):
    """Hybrid search of every 50th vector among all rows: inner products, and BM25 of the first
    sentence of its document over the texts of all rows."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    docs = table(s, d, "documents").select("doc_id", "text")
    said = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("vec_id"), F.get(T.claim_sentences(F.col("text")), F.lit(0)).alias("said"))
    ask = e.where("vec_id % 50 = 0").join(said, "vec_id", "left")
    return K.hybrid_top(e, "vec_id", "embedding", docs, "doc_id", "text", ask, "said", 0.7, 8)


@query("hybrid_search_whole")
def hybrid_search_whole(s, d):
    return whole_scores(s, d).select("q", "doc", F.round("score", 6).alias("score"), "rank")


@query("confident_topics_whole")
def confident_topics_whole(s, d):
    return Q.confident(whole_scores(s, d), "score", 0.52).groupBy("q").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("recommendation_records_whole")
def recommendation_records_whole(s, d):
    asked = table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"))
    r = Q.recommendation_records(asked, whole_scores(s, d), "q", "doc", [F.col("rank")], 5)
    return r.select("q", F.array_join(F.transform("recommended", lambda x: x.cast("string")), ",").alias("ids"))


@query("evidence_packets_whole")
def evidence_packets_whole(s, d):
    """Each query's claims are the sentences of its document, all with the evidence of their query."""
    t = table(s, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("q"), "text")
    claims = Q.claim_jobs(t.join(table(s, d, "embeddings").select(F.col("vec_id").alias("q")), "q", "left_semi"), "q", "text")
    found = claims.select("q", "claim_idx").join(whole_scores(s, d), "q")
    p = Q.evidence_packets(claims, found, "q", 2)
    text = F.transform("claims", lambda c: F.concat(c["claim_idx"].cast("string"), F.lit(":"), F.array_join(F.transform(c["evidence"], lambda e: e["doc"].cast("string")), ",")))
    return p.select("q", F.array_join(text, ";").alias("packet"))


@query("sentence_chunks", f"""WITH c AS (SELECT doc_id, {SENTENCES} AS ss FROM documents), f AS (SELECT doc_id, list_filter(ss, lambda x: len(string_split(x, ' ')) >= 3) AS ss FROM c)
SELECT doc_id, doc_id || '::sent::' || i AS chunk_id, ss[i + 1] AS chunk_text FROM (SELECT doc_id, ss, unnest(range(0, len(ss))) AS i FROM f)""")
def sentence_chunks(s, d):
    return Q.sentence_chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_id", "chunk_text")


@query("chunk_spans")
def chunk_spans(s, d):
    return Q.sentence_chunks(table(s, d, "documents"), "doc_id", "text", 0.1).select("doc_id", "sentence_id", "search_text", "start_char", "end_char")


@query("late_interaction")
def late_interaction(s, d):
    return Q.max_sim_sets(table(s, d, "embeddings"), "label", "vec_id", "embedding").select("q", "doc", F.round("score", 6).alias("score"))


ROWS = """
r AS (SELECT l_orderkey AS id, list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber) AS ids, list(1 ORDER BY l_linenumber) AS mask,
list(CASE WHEN l_linenumber = 1 AND l_orderkey % 10 <> 0 THEN -100 ELSE CAST(l_linenumber AS BIGINT) END ORDER BY l_linenumber) AS labels, list(CASE WHEN l_orderkey % 31 = 0 THEN -1.0 ELSE l_discount END ORDER BY l_linenumber) AS weights FROM lineitem GROUP BY 1)
"""


def trainer_rows(s, d):
    li = table(s, d, "lineitem")
    n = F.col("l_linenumber").cast("long")
    lab = F.when((n == 1) & (F.col("l_orderkey") % 10 != 0), F.lit(-100).cast("long")).otherwise(n)
    w = F.when(F.col("l_orderkey") % 31 == 0, -1.0).otherwise(F.col("l_discount"))
    g = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), lab.alias("lab"), w.alias("w")))).alias("x"))
    return g.select("id", F.col("x.n").alias("input_ids"), F.transform("x.n", lambda _: F.lit(1)).alias("attention_mask"), F.col("x.lab").alias("labels"), F.col("x.w").alias("loss_weights"))


@query("row_contract_violations", f"""WITH {ROWS}, v AS (SELECT count(*) FILTER (WHERE len(ids) = 0) AS empty, 0 AS unequal_lengths, count(*) FILTER (WHERE len(list_filter(ids, lambda x: x >= 6)) > 0) AS token_out_of_range, 0 AS bad_mask,
count(*) FILTER (WHERE len(list_filter(labels, lambda x: x >= 6)) > 0) AS bad_label, count(*) FILTER (WHERE len(list_filter(weights, lambda x: x < 0)) > 0) AS bad_weight, count(*) FILTER (WHERE len(list_filter(labels, lambda x: x <> -100)) = 0) AS no_target, count(*) FILTER (WHERE len(ids) > 5) AS too_long FROM r)
SELECT rule, CAST(n AS BIGINT) AS n FROM (UNPIVOT v ON COLUMNS(*) INTO NAME rule VALUE n)""")
def contract(s, d):
    return X.violation_counts(trainer_rows(s, d), 6, 5)


@query("first_bad_row", f"WITH {ROWS} SELECT min(id) AS id FROM r WHERE len(list_filter(weights, lambda x: x < 0)) > 0 OR len(ids) > 5 OR len(list_filter(ids, lambda x: x >= 6)) > 0 OR len(list_filter(labels, lambda x: x <> -100)) = 0")
def first_bad_row(s, d):
    return X.first_bad_row(trainer_rows(s, d), "id", 6, 5)


@query("label_masking", f"""WITH {ROWS} SELECT id, array_to_string(list_concat([-100, -100], list_transform(ids, lambda x, i: CASE WHEN i > len(ids) - k AND i < len(ids) THEN -100 ELSE x END)), ',') AS labels
FROM (SELECT id, ids, len(ids) - coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] NOT IN (4, 5))), 0) AS k FROM r)""")
def label_masking(s, d):
    r = trainer_rows(s, d)
    lab = S.answer_labels(F.array(F.lit(1), F.lit(2)), F.transform("input_ids", lambda x: x.cast("int")), [[4], [5]], "final_only")
    return r.select("id", F.array_join(F.transform(lab, lambda x: x.cast("string")), ",").alias("labels"))


@query("mask_and_pad", f"""WITH {ROWS} SELECT id, array_to_string(list_filter(ids, lambda x, i: labels[i] <> -100), ',') AS kept, array_to_string(list_concat(ids, list_transform(range(0, 8 - len(ids)), lambda x: 0)), ',') AS padded,
len(list_filter(labels, lambda x: x = -100)) AS prompt_len FROM r WHERE len(ids) < 8""")
def mask_and_pad(s, d):
    r = trainer_rows(s, d).where("size(input_ids) < 8")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rec = X.recover_prompt(F.col("input_ids"), F.col("labels"))
    return r.select(
        "id", text(S.kept_by_mask(F.col("input_ids"), F.col("labels"))).alias("kept"), text(S.padded(F.col("input_ids"), F.lit(8), 0)).alias("padded"),
        F.size(rec["prompt"]).cast("long").alias("prompt_len"),
    )


@query("manifest_counts", "SELECT o_orderstatus AS split, count(*) AS rows FROM orders GROUP BY 1")
def manifest_counts(s, d):
    return X.manifest(table(s, d, "orders").select(F.col("o_orderstatus").alias("split")), "split", {"seed": 42}).select("split", "rows")


@query("optional_prompt_rows", """SELECT doc_id, k.kind AS kind, CASE WHEN k.kind = 'title_body' THEN 'Title: ' || lang || chr(10) || 'Body: ' || source ELSE 'Title: ' || lang END AS prompt FROM documents, (VALUES ('title_body'), ('title_only')) k(kind) WHERE k.kind = 'title_body' OR doc_id % 4 = 0""")
def optional_prompts(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.explode(X.prompt_rows(F.col("lang"), F.col("source"), F.col("doc_id") % 4 == 0)).alias("p")).select("doc_id", "p.kind", "p.prompt")


@query("weighted_loss", """SELECT round(avg(x), 6) AS loss FROM (SELECT sum(l_tax * l_discount) / greatest(sum(l_discount), 1e-12) AS x, sum(l_discount) AS w FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey) WHERE w > 0""")
def weighted_loss(s, d):
    li = table(s, d, "lineitem").withColumn("m", F.col("l_quantity") > 10)
    return X.weighted_loss(li, "l_tax", "m", "l_discount", "l_orderkey", True).select(F.round("loss", 6).alias("loss"))


@query("null_filled_union", """SELECT doc_id, 'a' AS task, n_chars AS tokens, '' AS note FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'b', -1, lang FROM documents WHERE doc_id % 3 = 0""")
def null_filled_union(s, d):
    t = table(s, d, "documents")
    a = t.where("doc_id % 2 = 0").select("doc_id", F.lit("a").alias("task"), F.col("n_chars").alias("tokens"))
    b = t.where("doc_id % 3 = 0").select("doc_id", F.lit("b").alias("task"), F.col("lang").alias("note"))
    return a.unionByName(b, allowMissingColumns=True).select("doc_id", "task", F.coalesce("tokens", F.lit(-1)).alias("tokens"), F.coalesce("note", F.lit("")).alias("note"))


@query("error_classes", """SELECT event_id, CASE event_type WHEN 'error' THEN 'hard_quota' WHEN 'click' THEN 'quota' WHEN 'view' THEN 'transient' ELSE 'other' END AS class FROM events""")
def error_classes(s, d):
    t = F.col("event_type")
    msg = F.when(t == "error", "code RESOURCE_EXHAUSTED").when(t == "click", "HTTP 429 Too many").when(t == "view", "Connection reset").otherwise("no")
    return table(s, d, "events").select("event_id", P.error_class(msg).alias("class"))