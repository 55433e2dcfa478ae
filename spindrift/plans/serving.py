"""Serving and state queries.  Stand-ins: documents are the articles, labels the judge results,
and a document's source number modulo 5 its broad category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import relational as R
from spindrift.operators.order import numbered
from spindrift.plans.registry import query
from spindrift.sources.tables import table

ARTICLES = """
articles AS (SELECT doc_id AS source_id, text AS body_text, source AS section_id, lang, n_chars, left(text, 40) AS title FROM documents),
cat AS (SELECT DISTINCT source AS section_id, 'bucket' || (CAST(substr(source, 4) AS INTEGER) % 5) AS broad_category,
  CAST(CAST(substr(source, 4) AS INTEGER) % 5 AS BIGINT) AS category_rank FROM documents WHERE source IS NOT NULL),
judge AS (SELECT doc_id AS source_id, CASE WHEN quality = 1 THEN 'OK' ELSE 'PARSE_FAILED' END AS status, toxic = 1 AS parse_failed FROM labels),
ready AS (
  SELECT a.source_id, a.title, a.section_id, a.lang, a.n_chars, a.body_text, c.broad_category, c.category_rank
  FROM articles a JOIN judge j USING (source_id) JOIN cat c USING (section_id)
  WHERE j.status IN ('OK', 'REVISED') AND NOT coalesce(j.parse_failed, false) AND a.title IS NOT NULL
)
"""


def articles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(
        F.col("doc_id").alias("source_id"),
        F.col("text").alias("body_text"),
        F.col("source").alias("section_id"),
        "lang",
        "n_chars",
        F.left("text", F.lit(40)).alias("title"),
    )


def category_map(s: SparkSession, d: str) -> DataFrame:
    """The dimension, one row per section."""
    rank = (F.substring("source", 4, 9).cast("int") % 5).cast("long")
    return (
        table(s, d, "documents").where("source IS NOT NULL").select("source").distinct()
        .select(F.col("source").alias("section_id"), F.concat(F.lit("bucket"), rank).alias("broad_category"), rank.alias("category_rank"))
    )


def judged(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select(
        F.col("doc_id").alias("source_id"),
        F.when(F.col("quality") == 1, "OK").otherwise("PARSE_FAILED").alias("status"),
        (F.col("toxic") == 1).alias("parse_failed"),
    )


def quality_gate(df: DataFrame) -> DataFrame:
    """Confirmed results with a title."""
    return df.where(
        F.col("status").isin("OK", "REVISED") & ~F.coalesce("parse_failed", F.lit(False)) & F.col("title").isNotNull()
    )


def ready(s: SparkSession, d: str) -> DataFrame:
    return quality_gate(articles(s, d).join(judged(s, d), "source_id").join(category_map(s, d), "section_id"))


def newest():
    """The order that stands for newest first."""
    return [F.col("n_chars").desc_nulls_last(), F.col("source_id")]


@query("homepage_topn", f"""WITH {ARTICLES} SELECT broad_category, source_id, title, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY broad_category ORDER BY n_chars DESC NULLS LAST, source_id) AS rank FROM ready) WHERE rank <= 11""")
def homepage(s, d):
    top = R.top_per_group(ready(s, d), ["broad_category"], newest(), 11)
    return top.select("broad_category", "source_id", "title", F.col("rank").cast("long").alias("rank"))


@query("category_page", f"""WITH {ARTICLES}, c AS (SELECT * FROM ready WHERE broad_category = 'bucket2')
SELECT source_id, title, (SELECT count(*) FROM c) AS total FROM c ORDER BY n_chars DESC NULLS LAST, source_id LIMIT 20 OFFSET 20""")
def category_page(s, d):
    rows = ready(s, d).where("broad_category = 'bucket2'")
    return R.page(rows, newest(), 2, 20).select("source_id", "title", "total")


@query("category_list", f"""WITH {ARTICLES} SELECT broad_category, min(category_rank) AS category_rank FROM cat GROUP BY broad_category""")
def category_list(s, d):
    return category_map(s, d).groupBy("broad_category").agg(F.min("category_rank").alias("category_rank")).orderBy("category_rank", "broad_category")


@query("article_detail", f"""WITH {ARTICLES} SELECT a.source_id, a.title, c.broad_category, j.status FROM articles a LEFT JOIN judge j USING (source_id)
LEFT JOIN cat c USING (section_id) WHERE a.source_id % 97 = 5""")
def article_detail(s, d):
    return (
        articles(s, d).where("source_id % 97 = 5").join(judged(s, d), "source_id", "left")
        .join(category_map(s, d), "section_id", "left").select("source_id", "title", "broad_category", "status")
    )


@query("search_ranked", f"""WITH {ARTICLES}, f AS (SELECT *, CASE WHEN title ILIKE '%then%' THEN 0 WHEN broad_category ILIKE '%then%' THEN 1 ELSE 2 END AS search_rank
  FROM ready WHERE coalesce(title, '') || ' ' || coalesce(broad_category, '') || ' ' || coalesce(body_text, '') ILIKE '%then%')
SELECT source_id, title, CAST(search_rank AS BIGINT) AS search_rank, (SELECT count(*) FROM f) AS total FROM f
ORDER BY search_rank, n_chars DESC NULLS LAST, source_id LIMIT 15 OFFSET 15""")
def search(s, d, text="then", number=2, size=15):
    like = F.lit(f"%{' '.join(text.split())}%")
    doc = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "broad_category", "body_text")))
    rank = F.when(F.col("title").ilike(f"%{text}%"), 0).when(F.col("broad_category").ilike(f"%{text}%"), 1).otherwise(2)
    found = ready(s, d).where(F.ilike(doc, like)).withColumn("search_rank", rank.cast("long"))
    return R.page(found, [F.col("search_rank"), *newest()], number, size).select("source_id", "title", "search_rank", "total")


STATE = """
st AS (SELECT doc_id AS source_id, n_chars, doc_id % 3 = 0 AS has_h, doc_id % 5 = 0 AS inel_h, doc_id % 4 = 0 AS has_b, doc_id % 7 = 0 AS inel_b FROM documents)
"""


def outputs(s, d) -> DataFrame:
    """(source_id, task) of finished tasks."""
    t = table(s, d, "documents").select(F.col("doc_id").alias("source_id"))
    return t.where("source_id % 3 = 0").withColumn("task", F.lit("highlight")).unionAll(
        t.where("source_id % 4 = 0").withColumn("task", F.lit("both"))
    )


def ineligible(s, d) -> DataFrame:
    t = table(s, d, "documents").select(F.col("doc_id").alias("source_id"))
    return t.where("source_id % 5 = 0").withColumn("task", F.lit("highlight")).unionAll(
        t.where("source_id % 7 = 0").withColumn("task", F.lit("both"))
    )


def task_state(s, d) -> DataFrame:
    """Articles with their four task flags."""
    df = articles(s, d)
    for name, rows, task in (
        ("has_h", outputs(s, d), "highlight"), ("inel_h", ineligible(s, d), "highlight"),
        ("has_b", outputs(s, d), "both"), ("inel_b", ineligible(s, d), "both"),
    ):
        df = R.with_flag(df, rows.where(F.col("task") == task), ["source_id"], name)
    return df


PENDING = "(NOT has_h AND NOT inel_h) OR (NOT has_b AND NOT inel_b)"


@query("pending_flags", f"WITH {STATE} SELECT source_id, has_h, inel_h, has_b, inel_b FROM st WHERE {PENDING}")
def pending_flags(s, d):
    return task_state(s, d).where(PENDING).select("source_id", "has_h", "inel_h", "has_b", "inel_b")


@query("pending_limited", f"""WITH {STATE} SELECT source_id FROM st WHERE ({PENDING}) AND source_id NOT IN (1, 2) ORDER BY n_chars DESC NULLS LAST, source_id LIMIT 25""")
def pending_limited(s, d):
    return R.scoped(task_state(s, d).where(PENDING), "source_id", None, [1, 2]).orderBy(*newest()).limit(25).select("source_id")


@query("completed_both", """SELECT doc_id AS source_id FROM documents WHERE doc_id % 12 = 0""")
def completed_both(s, d):
    o = outputs(s, d)
    both = o.where("task = 'both'").select("source_id")
    return articles(s, d).select("source_id").join(o.where("task = 'highlight'").select("source_id"), "source_id", "left_semi").join(both, "source_id", "left_semi")


@query("pending_anti", """SELECT doc_id AS source_id FROM documents d WHERE doc_id % 12 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 30""")
def pending_anti(s, d):
    done = completed_both(s, d).join(judged(s, d).select("source_id"), "source_id", "left_anti")
    return articles(s, d).join(done, "source_id", "left_semi").orderBy(*newest()).limit(30).select("source_id")


@query("pending_task_rows", f"""WITH {STATE}, st2 AS (SELECT * FROM st WHERE {PENDING})
SELECT 'highlight' AS task, source_id FROM st2 WHERE NOT has_h AND NOT inel_h UNION ALL SELECT 'both', source_id FROM st2 WHERE NOT has_b AND NOT inel_b""")
def pending_task_rows(s, d):
    p = task_state(s, d).where(PENDING)
    one = p.where("NOT has_h AND NOT inel_h").select(F.lit("highlight").alias("task"), "source_id")
    return one.unionAll(p.where("NOT has_b AND NOT inel_b").select(F.lit("both").alias("task"), "source_id"))


@query("ineligible_requested", """SELECT DISTINCT turn AS source_id FROM conversations WHERE turn NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)""")
def ineligible_requested(s, d):
    asked = table(s, d, "conversations").select(F.col("turn").alias("source_id"))
    return asked.distinct().join(outputs(s, d).where("task = 'highlight'").select("source_id"), "source_id", "left_anti")


RECS = """
recs AS (SELECT vec_id AS source_id, list_transform(range(0, vec_id % 4), lambda k: (vec_id * 7 + k * 13) % 500) AS ids FROM embeddings)
"""


@query("recommendations_ordinality", f"""WITH {RECS} SELECT r.source_id, u.pos AS position, u.id AS recommended, d.n_chars FROM recs r,
  LATERAL (SELECT unnest(r.ids) AS id, unnest(range(1, len(r.ids) + 1)) AS pos) u JOIN documents d ON d.doc_id = u.id""")
def recommendations(s, d):
    ids = F.when(F.col("vec_id") % 4 > 0, F.transform(F.sequence(F.lit(0), F.greatest((F.col("vec_id") % 4 - 1).cast("int"), F.lit(0))), lambda k: (F.col("vec_id") * 7 + k * 13) % 500))
    recs = table(s, d, "embeddings").select(F.col("vec_id").alias("source_id"), ids.alias("ids"))
    flat = recs.select("source_id", F.posexplode("ids").alias("pos", "recommended"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("recommended"), "n_chars")
    return flat.join(docs, "recommended").select("source_id", (F.col("pos") + 1).cast("long").alias("position"), "recommended", "n_chars")


SYNC = """
tgt AS (SELECT p_partkey AS k, p_brand AS a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS b, CAST(p_size AS BIGINT) AS c FROM part WHERE p_partkey % 4 <> 0),
stg AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'new' ELSE p_brand END AS a, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS b, CAST(p_size AS BIGINT) AS c FROM part WHERE p_partkey % 6 <> 0)
"""


def _sync_sides(s, d):
    p = table(s, d, "part")
    size = F.col("p_size").cast("long").alias("c")
    t = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("a"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("b"), size)
    g = p.where("p_partkey % 6 <> 0").select(
        F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 9 == 0, "new").otherwise(F.col("p_brand")).alias("a"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("b"), size,
    )
    return t, g


@query("sync_plan", f"""WITH {SYNC} SELECT coalesce(t.k, g.k) AS k, CASE WHEN t.k IS NULL THEN 'insert' WHEN g.k IS NULL THEN 'delete'
  WHEN t.a IS NOT DISTINCT FROM g.a AND t.b IS NOT DISTINCT FROM g.b AND t.c IS NOT DISTINCT FROM g.c THEN 'unchanged' ELSE 'update' END AS action
FROM tgt t FULL JOIN stg g ON t.k = g.k""")
def sync(s, d):
    return R.sync_plan(*_sync_sides(s, d), "k")


@query("sync_stats", f"""WITH {SYNC} SELECT action, count(*) AS n FROM (SELECT CASE WHEN t.k IS NULL THEN 'insert' WHEN g.k IS NULL THEN 'stale'
  WHEN t.a IS NOT DISTINCT FROM g.a AND t.b IS NOT DISTINCT FROM g.b AND t.c IS NOT DISTINCT FROM g.c THEN 'unchanged' ELSE 'update' END AS action
FROM tgt t FULL JOIN stg g ON t.k = g.k) GROUP BY action""")
def sync_stats(s, d):
    return R.sync_plan(*_sync_sides(s, d), "k", delete_stale=False).groupBy("action").agg(F.count("*").alias("n"))


@query("vector_sync_plan", f"""WITH {SYNC}, t AS (SELECT k, md5(a) AS v, md5(coalesce(b, '')) AS m FROM tgt), g AS (SELECT k, md5(a) AS v, md5(coalesce(b, '')) AS m FROM stg)
SELECT coalesce(t.k, g.k) AS k, CASE WHEN t.k IS NULL THEN 'insert' WHEN g.k IS NULL THEN 'delete' WHEN t.v <> g.v THEN 'vector_update' WHEN t.m <> g.m THEN 'metadata_update' ELSE 'unchanged' END AS action
FROM t FULL JOIN g ON t.k = g.k""")
def vector_sync(s, d):
    sides = [x.select("k", F.md5("a").alias("v"), F.md5(F.coalesce("b", F.lit(""))).alias("m")) for x in _sync_sides(s, d)]
    return R.hash_sync_plan(*sides, "k", "v", "m")


@query("conditional_upsert", f"""WITH {SYNC} SELECT coalesce(t.k, g.k) AS k, CASE WHEN t.k IS NULL THEN 'insert' WHEN g.k IS NULL THEN 'keep' WHEN t.a IS DISTINCT FROM g.a THEN 'update' ELSE 'unchanged' END AS action,
  CASE WHEN t.k IS NULL OR (g.k IS NOT NULL AND t.a IS DISTINCT FROM g.a) THEN g.a ELSE t.a END AS a,
  CASE WHEN t.k IS NULL OR (g.k IS NOT NULL AND t.a IS DISTINCT FROM g.a) THEN g.b ELSE t.b END AS b,
  CASE WHEN t.k IS NULL OR (g.k IS NOT NULL AND t.a IS DISTINCT FROM g.a) THEN g.c ELSE t.c END AS c FROM tgt t FULL JOIN stg g ON t.k = g.k""")
def conditional_upsert(s, d):
    return R.conditional_upsert(*_sync_sides(s, d), "k", ["a"])


@query("upsert_latest", f"""WITH {SYNC} SELECT k, a, b, c FROM stg UNION ALL SELECT k, a, b, c FROM tgt WHERE k NOT IN (SELECT k FROM stg)""")
def upsert_latest(s, d):
    t, g = _sync_sides(s, d)
    return R.upsert(t, g, ["k"], [F.col("k")])


@query("insert_if_absent", """WITH b AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, event_id FROM b WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 20 = 0 AND e.user_id = b.user_id AND e.event_type = b.event_type)""")
def insert_if_absent(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "event_id")
    return R.insert_if_absent(e.where("event_id % 20 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], [F.col("event_id")])


@query("insert_stats", """WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1), n AS (SELECT count(*) AS received FROM events WHERE event_id % 2 = 1)
SELECT (SELECT received FROM n) AS received, count(*) AS inserted FROM b WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 20 = 0 AND e.user_id = b.user_id AND e.event_type = b.event_type)""")
def insert_stats(s, d):
    received = table(s, d, "events").where("event_id % 2 = 1").agg(F.count("*").alias("received"))
    return received.crossJoin(insert_if_absent(s, d).agg(F.count("*").alias("inserted")))


@query("unmatched_full_outer", """WITH l AS (SELECT conv_id AS id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
r AS (SELECT doc_id AS id, quality FROM labels WHERE doc_id % 2 = 0)
SELECT coalesce(l.id, r.id) AS id, coalesce(l.turn, -1) AS turn, CAST(coalesce(r.quality, -1) AS BIGINT) AS quality FROM (SELECT * FROM l WHERE n = 1) l FULL JOIN r ON l.id = r.id
UNION ALL SELECT id, turn, -1 FROM l WHERE n > 1""")
def unmatched_full_outer(s, d):
    left = table(s, d, "conversations").select(F.col("conv_id").alias("id"), "turn")
    right = table(s, d, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality"))
    return R.assemble_states(left, right, "id", ["turn"], ["quality"]).fillna(-1, ["turn", "quality"])


@query("distinct_on_rank", """SELECT n_regionkey, n_nationkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END NULLS LAST, n_name) AS rn FROM nation) WHERE rn = 1""")
def distinct_on(s, d):
    rank = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey"))
    return R.keep_first(table(s, d, "nation"), ["n_regionkey"], [rank.asc_nulls_last(), F.col("n_name")]).select("n_regionkey", "n_nationkey", "n_name")


@query("resume_keep_last", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE value IS NOT NULL AND event_type <> 'error') WHERE rn = 1""")
def resume_keep_last(s, d):
    e = table(s, d, "events").where("value IS NOT NULL AND event_type <> 'error'")
    return R.keep_last(e, ["user_id"], "event_id").select("user_id", "event_id", "value")


@query("prefix_before_seen", """WITH p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id DESC) AS pos FROM events)
SELECT event_id, pos FROM p WHERE pos < (SELECT min(pos) FROM p WHERE user_id % 50 = 7) ORDER BY pos LIMIT 40""")
def prefix_before_seen(s, d):
    p = numbered(table(s, d, "events").select("event_id", "user_id"), [F.col("event_id").desc()], "pos", 1)
    return R.prefix_before_seen(p, "pos", F.col("user_id") % 50 == 7, 40).select("event_id", "pos")


@query("scope_union_first_seen", """SELECT id, min(pos) AS pos FROM (SELECT c_custkey AS id, c_custkey AS pos FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey AS id, 1000000 + s_suppkey AS pos FROM supplier) GROUP BY id""")
def scope_union(s, d):
    a = table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 1000000).alias("pos"))
    return a.unionByName(b).groupBy("id").agg(F.min("pos").alias("pos"))


@query("retrieval_completion_order", """SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS position FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def completion_order(s, d):
    ok = table(s, d, "labels").where("quality = 1").select("doc_id")
    return numbered(table(s, d, "documents").select("doc_id").join(ok, "doc_id", "left_semi"), [F.col("doc_id").desc()], "position", 1)
