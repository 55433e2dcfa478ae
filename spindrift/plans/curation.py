"""Curation queries: labels, clusters, graphs, representatives, quotas and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.operators import labels as L
from spindrift.operators import relational as R
from spindrift.operators import sampling as P
from spindrift.operators import vectors as V
from spindrift.operators.order import numbered
from spindrift.plans.registry import query
from spindrift.sources.tables import table

DIM = 64
LABELS = "labels_of AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS ls FROM events GROUP BY user_id)"


def item_labels(s, d):
    """Users as items, their event types as labels."""
    return table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("ls"))


def emb(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding"), F.col("label").cast("long").alias("label"))


@query("category_inventory", "SELECT trim(source) AS category, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY 1")
def category_inventory(s, d):
    return table(s, d, "documents").groupBy(F.trim("source").alias("category")).agg(F.count("*").alias("n")).where("category <> ''").orderBy(F.col("n").desc(), "category")


@query("label_counts", f"WITH {LABELS} SELECT label, count(*) AS n FROM (SELECT unnest(ls) AS label FROM labels_of) GROUP BY label")
def label_counts(s, d):
    return L.label_counts(item_labels(s, d), "user_id", "ls")


@query("small_counter_share", """WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT label, n, round(n / sum(n) OVER (), 9) AS share, round(sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS cum_share FROM c""")
def counter_share(s, d):
    c = table(s, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    r = R.running_share(c, "n", "label")
    return r.select("label", "n", F.round("share", 9).alias("share"), F.round("cum_share", 9).alias("cum_share"))


@query("primary_label_bucket", f"""WITH {LABELS}, c AS (SELECT label, count(*) AS n FROM (SELECT unnest(ls) AS label FROM labels_of) GROUP BY label),
p AS (SELECT user_id, label AS primary_label FROM (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY n, label) AS rn FROM (SELECT user_id, unnest(ls) AS label FROM labels_of) JOIN c USING (label)) WHERE rn = 1)
SELECT user_id, primary_label, count(*) OVER (PARTITION BY primary_label) < 12 AS protected FROM p""")
def primary_label(s, d, protect=12):
    return L.primary_labels(item_labels(s, d), "user_id", "ls", protect)


@query("label_space", "SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM events)")
def label_space(s, d):
    return L.label_space(item_labels(s, d), "user_id", "ls")


@query("canonical_labels", """WITH sp AS (SELECT event_type AS label, row_number() OVER (ORDER BY event_type DESC) AS idx FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))
SELECT user_id, string_agg(label, ',' ORDER BY idx) AS labels FROM (SELECT DISTINCT user_id, event_type AS label FROM events) JOIN sp USING (label) GROUP BY user_id""")
def canonical_labels(s, d):
    """Known labels only, once each, in the space's order (here the names' order reversed)."""
    items = item_labels(s, d)
    space = L.label_space(items, "user_id", "ls").where("label <> 'error'").withColumn("idx", -F.col("idx"))
    return L.canonical(items, "user_id", "ls", space).select("user_id", F.array_join("labels", ",").alias("labels"))


@query("assignment_validation", """WITH a AS (SELECT p_brand AS g, p_type AS m FROM part WHERE p_partkey % 3 = 0), u AS (SELECT DISTINCT p_type AS m FROM part WHERE p_size < 40)
SELECT 'missing' AS problem, m AS member FROM u WHERE m NOT IN (SELECT m FROM a) UNION ALL SELECT 'extra', m FROM (SELECT DISTINCT m FROM a) WHERE m NOT IN (SELECT m FROM u)
UNION ALL SELECT 'duplicate', m FROM a GROUP BY m HAVING count(*) > 1""")
def assignment_validation(s, d):
    p = table(s, d, "part")
    a = p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("member"))
    u = p.where("p_size < 40").select(F.col("p_type").alias("member")).distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("problem"), "member")
    return (
        tag(u.join(a, "member", "left_anti"), "missing").unionAll(tag(a.distinct().join(u, "member", "left_anti"), "extra"))
        .unionAll(tag(R.unique_violations(a, ["member"]), "duplicate"))
    )


@query("cluster_stats", """WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 3 <> 1 OR label > 4 GROUP BY label)
SELECT count(*) AS clusters, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n > 1) AS grown, max(n) AS largest, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS covered FROM c""")
def cluster_stats(s, d):
    c = emb(s, d).where("vec_id % 3 <> 1 OR label > 4").groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(
        F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") > 1).alias("grown"), F.max("n").alias("largest"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("covered"),
    )


@query("cluster_threshold_histogram", """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(t AS BIGINT) AS threshold, count(*) FILTER (WHERE n >= t) AS clusters, CAST(coalesce(sum(n) FILTER (WHERE n >= t), 0) AS BIGINT) AS rows_in FROM c, (VALUES (1), (2), (5), (20), (30), (40)) v(t) GROUP BY t""")
def threshold_histogram(s, d):
    c = table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.lit(t) for t in (1, 2, 5, 20, 30, 40)))).alias("threshold")
    x = c.groupBy("n").agg(F.count("*").alias("m")).select("n", "m", each)
    ok = F.col("n") >= F.col("threshold")
    return x.groupBy(F.col("threshold").cast("long").alias("threshold")).agg(
        F.sum(F.when(ok, F.col("m")).otherwise(0)).alias("clusters"), F.sum(F.when(ok, F.col("n") * F.col("m")).otherwise(0)).alias("rows_in")
    )


@query("sampling_summary", """WITH m AS (SELECT o_custkey % 50 AS cl, o_orderkey % 7 = 0 AS picked FROM orders)
SELECT cl AS cluster, count(*) AS orig, count(*) FILTER (WHERE picked) AS picked, round(count(*) FILTER (WHERE picked) / count(*), 9) AS ratio, round(count(*) / sum(count(*)) OVER (), 9) AS orig_share FROM m GROUP BY cl""")
def sampling_summary(s, d):
    m = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("cluster"), (F.col("o_orderkey") % 7 == 0).alias("picked"))
    g = m.groupBy("cluster").agg(F.count("*").alias("orig"), F.count_if(F.col("picked")).alias("picked"))
    return g.select("cluster", "orig", "picked", F.round(F.col("picked") / F.col("orig"), 9).alias("ratio"), F.round(F.col("orig") / F.sum("orig").over(Window.partitionBy()), 9).alias("orig_share"))


@query("global_cluster_ids", """WITH k AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1), o AS (SELECT n_regionkey, coalesce(sum(n) OVER (ORDER BY n_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM k)
SELECT n_nationkey, CAST(off + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS global_id FROM nation JOIN o USING (n_regionkey)""")
def global_ids(s, d):
    n = table(s, d, "nation")
    off = R.grouped_offsets(n.groupBy("n_regionkey").agg(F.count("*").alias("n")), "n_regionkey", "n")
    local = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    return n.withColumn("local", local).join(F.broadcast(off), "n_regionkey").select("n_nationkey", (F.col("offset") + F.col("local")).cast("long").alias("global_id"))


CENT = """
x AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(1, 65)) AS i FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i), nrm AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM c GROUP BY label),
s AS (SELECT vec_id, x.label, round(sum(v * m / nrm), 9) AS sim FROM x JOIN c USING (label, i) JOIN nrm ON nrm.label = x.label GROUP BY vec_id, x.label),
r AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS size, sim, round(1 - sim, 9) AS dist, row_number() OVER (PARTITION BY label ORDER BY round(1 - sim, 9), vec_id) - 1 AS rank FROM s)
"""


@query("cluster_centroid_rank", f"WITH {CENT} SELECT vec_id, label, size, round(sim, 6) AS sim, rank FROM r")
def centroid_rank(s, d):
    return V.centroid_ranks(emb(s, d), "vec_id", "label", "embedding", DIM).select("vec_id", "label", "size", F.round("sim", 6).alias("sim"), "rank")


@query("gap_representatives", f"""WITH {CENT}, k AS (SELECT *, CAST(least(1 + floor(sqrt(size)), 20, size) AS BIGINT) AS k, rank > 0 AND rank < size - 1 AS inner_, dist - lag(dist) OVER (PARTITION BY label ORDER BY rank) AS gap FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY label, inner_ ORDER BY round(gap, 9) DESC NULLS LAST, rank DESC) AS gr FROM k)
SELECT vec_id, label, rank FROM g WHERE k >= size OR (k = 1 AND rank = 0) OR (k >= 2 AND (NOT inner_ OR gr <= k - 2))""")
def gap_representatives(s, d):
    ranked = V.centroid_ranks(emb(s, d), "vec_id", "label", "embedding", DIM)
    return V.gap_representatives(ranked, "vec_id", "label", S.sample_size_sqrt(F.col("size"), 1.0, 20)).select("vec_id", "label", "rank")


KNN = """
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM p) WHERE rank <= 10)
"""


@query("knn_topk", f"WITH {KNN} SELECT src, dst, rank, round(sim, 6) AS sim FROM nn")
def knn_topk(s, d):
    e = emb(s, d)
    return V.knn(e, e, "vec_id", "embedding", 10).select("src", "dst", "rank", F.round("sim", 6).alias("sim"))


@query("knn_approximate")
def knn_approximate(s, d):
    e = emb(s, d)
    return V.knn_approximate(e, e, "vec_id", "embedding", 10)


@query("percentile_threshold", f"WITH {KNN} SELECT round(quantile_cont(sim, 0.6), 6) AS threshold FROM nn")
def percentile_threshold(s, d):
    e = emb(s, d)
    return V.percentile(V.knn(e, e, "vec_id", "embedding", 10), "sim", 0.6, 0.5).select(F.round("threshold", 6).alias("threshold"))


@query("mutual_edges", f"WITH {KNN} SELECT least(a.src, a.dst) AS u, greatest(a.src, a.dst) AS v, round(max(a.sim), 6) AS weight FROM nn a JOIN nn b ON a.src = b.dst AND a.dst = b.src GROUP BY 1, 2")
def mutual_edges(s, d):
    e = emb(s, d)
    return V.undirected(V.mutual(V.cut(V.knn(e, e, "vec_id", "embedding", 10)))).select("u", "v", F.round("weight", 6).alias("weight"))


@query("graph_edges", f"""WITH {KNN}, t AS (SELECT * FROM nn WHERE rank <= 5 AND sim >= (SELECT quantile_cont(sim, 0.4) FROM nn WHERE rank <= 5))
SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(max(sim), 6) AS weight FROM t GROUP BY 1, 2""")
def graph_edges(s, d):
    e = emb(s, d)
    return V.graph_edges(V.cut(V.knn(e, e, "vec_id", "embedding", 10)), 0.4, 0.5, False, 5).select("u", "v", F.round("weight", 6).alias("weight"))


@query("graph_components", f"""WITH RECURSIVE {KNN}, t AS (SELECT * FROM nn WHERE rank <= 2), e AS (SELECT src AS u, dst AS v FROM t UNION SELECT dst, src FROM t),
w AS (SELECT DISTINCT u AS node, u AS root FROM e UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.node) SELECT node, min(root) AS component FROM w GROUP BY node""")
def graph_components(s, d):
    e = emb(s, d)
    nn = V.knn(e, e, "vec_id", "embedding", 2)
    return V.connected(V.undirected(nn).select("u", "v"), e.select(F.col("vec_id").alias("node")))


@query("communities")
def communities(s, d):
    e = emb(s, d)
    nn = V.cut(V.knn(e, e, "vec_id", "embedding", 10))
    nodes = e.select(F.col("vec_id").alias("node"))
    found = V.communities(V.graph_edges(nn, 0.4, 0.5, False, 5), nodes)
    found = V.attach_singletons(found, nn, 0.3)
    return V.pair_singletons(found, nn, 0.3)


@query("sample_sizes", """SELECT l_partkey, n AS size, CAST(least(1 + floor(sqrt(n) / 1.5), 6, n) AS BIGINT) AS k_sqrt, CAST(least(1 + floor(ln(n) / ln(3.0)), 4, n) AS BIGINT) AS k_log FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n NOT IN (1, 3, 9, 27, 81)""")
def sample_sizes(s, d):
    c = table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("size")).where(~F.col("size").isin(1, 3, 9, 27, 81))
    return c.select("l_partkey", "size", S.sample_size_sqrt(F.col("size"), 1.5, 6).alias("k_sqrt"), S.sample_size_log(F.col("size"), 3.0, 4).alias("k_log"))


@query("largest_remainder", """WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT p, n, round(97 * n / sum(n) OVER (), 9) AS x FROM c), f AS (SELECT *, floor(x) AS f FROM x)
SELECT p, n, CAST(f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, p) <= 97 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def largest_remainder(s, d):
    c = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return P.largest_remainder(c, "n", 97, "p")


@query("allocation")
def allocation(s, d):
    c = table(s, d, "lineitem").groupBy((F.col("l_partkey") % 300).alias("cluster")).agg(F.count("*").alias("size"))
    return P.allocate(c, "cluster", "size", 1000, 20)


EPOCH = "pool AS (SELECT n_name AS item, CASE WHEN n_nationkey % 3 = 0 THEN 'a' ELSE 'b' END AS src, CAST(n_nationkey % 2 AS BIGINT) AS usage FROM nation)"


@query("usage_balanced_sample", f"""WITH {EPOCH}, l AS (SELECT src, item, usage + unnest(range(0, 9)) AS level FROM pool),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY level, md5('7:' || src || ':' || item), item) AS rn FROM l) SELECT src, item, level FROM r WHERE rn <= CASE src WHEN 'a' THEN 14 ELSE 6 END""")
def usage_balanced(s, d):
    n = table(s, d, "nation")
    pool = n.select(F.col("n_name").alias("item"), F.when(F.col("n_nationkey") % 3 == 0, "a").otherwise("b").alias("src"), (F.col("n_nationkey") % 2).cast("long").alias("usage"))
    return P.epoch_sample(pool, "src", "item", "usage", {"a": 14, "b": 6}, "7")


@query("seeded_take", """SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100""")
def seeded_take(s, d):
    return P.seeded_take(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 42, 100)


@query("rank_shard", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos % 4 = 3""")
def rank_shard(s, d):
    o = numbered(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "pos")
    return P.rank_shard(o, "pos", 3, 4).select("o_orderkey")


@query("rows_by_label_first_seen", """SELECT event_type AS label, min(event_id) AS first, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY 1""")
def rows_by_label(s, d):
    g = table(s, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.sort_array(F.collect_list("event_id")).alias("x"))
    return g.select("label", F.get("x", F.lit(0)).alias("first"), F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("ids")).orderBy("first")


@query("argmax_weight", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1""")
def argmax_weight(s, d):
    key = F.struct(F.col("l_extendedprice"), (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))
    m = table(s, d, "lineitem").agg(F.max(key).alias("m"))
    return m.select((-F.col("m.o")).alias("l_orderkey"), (-F.col("m.n")).cast("long").alias("l_linenumber"), F.col("m.l_extendedprice").alias("l_extendedprice"))


@query("idf_weights", r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM documents), f AS (SELECT t, count(*) AS df FROM w GROUP BY t)
SELECT t AS token, df, round(greatest(1.0, least(2.0, 0.5 * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)))), 9) AS weight FROM f WHERE df >= 3""")
def idf_weights(s, d):
    t = table(s, d, "documents")
    w = t.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    f = w.groupBy("token").agg(F.count("*").alias("df")).where("df >= 3")
    return f.join(F.broadcast(t.agg(F.count("*").alias("n")))).select("token", "df", F.round(S.idf_weight(F.col("n"), F.col("df"), 0.5, 2.0), 9).alias("weight"))
