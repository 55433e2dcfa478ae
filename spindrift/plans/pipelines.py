"""Composed pipelines and the remaining state, validation and text queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import parsing
from spindrift.functions import scalars as S
from spindrift.functions import text as T
from spindrift.operators import coverage as C
from spindrift.operators import features as X
from spindrift.operators import relational as R
from spindrift.operators import sampling as P
from spindrift.operators import trainer as Y
from spindrift.operators import validation as V
from spindrift.operators.order import numbered
from spindrift.plans import curation, serving
from spindrift.plans.registry import query
from spindrift.sources import files
from spindrift.sources.tables import table


@query("load_clean_corpus", r"""SELECT doc_id AS source_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')[1:8], ' ') AS repr
FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) > 20""")
def load_clean(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("source_idx"), T.collapse(F.col("text")).alias("clean"))
    return t.where(F.length("clean") > 20).select("source_idx", "clean", T.first_words(F.col("clean"), 8).alias("repr"))


@query("requested_positions", """SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) - 1 AS pos FROM documents) WHERE pos IN (0, 3, 7, 100, 100000)""")
def requested_positions(s, d):
    t = table(s, d, "documents").select("doc_id", "n_chars")
    return numbered(t, [F.col("n_chars").desc_nulls_last(), "doc_id"], "pos").select("doc_id", "pos").where(F.col("pos").isin(0, 3, 7, 100, 100000))


@query("samples_after_validity", """SELECT d.doc_id, l.quality AS quality FROM documents d JOIN labels l USING (doc_id) WHERE length(d.text) > 100 AND d.lang <> 'en' ORDER BY doc_id LIMIT 25""")
def samples_after_validity(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").where((F.length("text") > 100) & (F.col("lang") != "en"))
    return j.orderBy("doc_id").limit(25).select("doc_id", "quality")


@query("similarity_base", """SELECT doc_id, combo, keywords FROM (SELECT doc_id, lower(lang) || ', ' || lower(source) AS combo, source AS keywords, row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC) AS rn
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND length(trim(text)) > 0 AND lang IS NOT NULL AND source IS NOT NULL) WHERE rn = 1""")
def similarity_base(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels").where("quality = 1"), "doc_id").where("length(trim(text)) > 0 AND lang IS NOT NULL AND source IS NOT NULL")
    j = j.select("doc_id", "n_chars", T.normalize_combination(F.concat("lang", F.lit(" ,"), "source")).alias("combo"), F.array_join(T.split_keywords(F.col("source")), ", ").alias("keywords"))
    return R.keep_first(j, ["doc_id"], [F.col("n_chars").desc()]).select("doc_id", "combo", "keywords")


@query("combo_table", """SELECT lower(lang) || ', ' || lower(source) AS combo, count(*) AS n, min(doc_id) AS first FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND length(trim(text)) > 0 AND lang IS NOT NULL AND source IS NOT NULL GROUP BY 1""")
def combo_table(s, d):
    return similarity_base(s, d).groupBy("combo").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("merged_scoring_input", """SELECT l.doc_id, coalesce(nullif(trim(CASE WHEN d.doc_id % 2 = 0 THEN d.source END), ''), nullif(trim(o.lang), ''), '') AS response, CASE WHEN d.doc_id % 2 = 0 THEN 'judge' WHEN o.lang IS NOT NULL THEN 'output' ELSE 'none' END AS provenance
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang <> 'en') o ON o.doc_id = l.doc_id""")
def merged_scoring_input(s, d):
    docs = table(s, d, "documents")
    a = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("a"), (F.col("doc_id") % 2 == 0).alias("even"))
    o = docs.where("lang <> 'en'").select("doc_id", F.col("lang").alias("o"))
    j = table(s, d, "labels").select("doc_id").join(a, "doc_id", "left").join(o, "doc_id", "left")
    prov = F.when(F.col("even"), "judge").when(F.col("o").isNotNull(), "output").otherwise("none")
    return j.select("doc_id", T.first_text(F.col("a"), F.col("o")).alias("response"), prov.alias("provenance"))


@query("packet_index_fallback", """SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000 END, row_number() OVER (ORDER BY coalesce(CASE WHEN doc_id % 5 > 0 THEN n_chars END, doc_id), doc_id)) AS packet_index FROM documents""")
def packet_index(s, d):
    when = F.coalesce(F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")), F.col("doc_id"))
    t = numbered(table(s, d, "documents").select("doc_id", when.alias("at")), ["at", "doc_id"], "row", 1)
    return t.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1000000), "row").alias("packet_index"))


@query("article_validity", """SELECT doc_id, text IS NOT NULL AND trim(left(text, 30)) <> '' AND length(text) >= 200 AND source IN ('src1', 'src2', 'src3') AS valid FROM documents""")
def article_validity(s, d):
    ok = F.col("text").isNotNull() & (F.trim(F.left("text", F.lit(30))) != "") & (F.length("text") >= 200) & F.col("source").isin("src1", "src2", "src3")
    return table(s, d, "documents").select("doc_id", ok.alias("valid"))


@query("confirmed_results", """SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0 AND coalesce(trim(lang), '') <> '' AND coalesce(trim(source), '') <> ''""")
def confirmed_results(s, d):
    j = table(s, d, "labels").where("quality = 1 AND toxic = 0").join(table(s, d, "documents"), "doc_id")
    return j.where((T.first_text(F.col("lang")) != "") & (T.first_text(F.col("source")) != "")).select("doc_id")


@query("row_completeness", """SELECT event_id, value IS NOT NULL AND NOT isnan(value) AND props <> '' AS complete FROM events""")
def row_completeness(s, d):
    return table(s, d, "events").select("event_id", (F.col("value").isNotNull() & ~F.isnan("value") & (F.col("props") != "")).alias("complete"))


@query("chunk_ingest", """SELECT k, doc_id FROM (SELECT md5(left(text, 30)) AS k, doc_id, row_number() OVER (PARTITION BY md5(left(text, 30)) ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) WHERE rn = 1 AND k NOT IN (SELECT md5(left(text, 30)) FROM documents WHERE doc_id % 5 = 1 AND text IS NOT NULL)""")
def chunk_ingest(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL").select(F.md5(F.left("text", F.lit(30))).alias("k"), "doc_id")
    return R.insert_if_absent(t.where("doc_id % 5 = 1"), t.where("doc_id % 2 = 0"), ["k"], [F.col("doc_id")])


@query("chunk_ingest_whole")
def chunk_ingest_whole(s, d):
    """All documents come in, keyed by their whole texts; a null text has no key and stays out."""
    t = table(s, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("k"), "doc_id")
    return R.insert_if_absent(t.where("doc_id % 5 = 1"), t, ["k"], [F.col("doc_id")])


@query("recommendation_upsert", """SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN '' WHEN vec_id % 2 = 0 THEN vec_id || ',' || (vec_id + 1) ELSE 'old' END AS ids FROM embeddings""")
def recommendation_upsert(s, d):
    e = table(s, d, "embeddings").select("vec_id")
    old = e.select("vec_id", F.lit("old").alias("ids"))
    v = F.col("vec_id").cast("string")
    new = e.where("vec_id % 2 = 0").select("vec_id", F.when(F.col("vec_id") % 10 == 0, "").otherwise(F.concat(v, F.lit(","), (F.col("vec_id") + 1).cast("string"))).alias("ids"))
    return R.upsert(old, new, ["vec_id"], [F.col("vec_id")])


@query("picked_export", """SELECT pos, o_orderkey AS orig_idx, o_custkey % 50 AS cluster_id FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos FROM orders WHERE o_orderkey % 11 = 0)""")
def picked_export(s, d):
    picks = table(s, d, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("orig_idx"))
    picks = numbered(picks, [F.col("orig_idx").desc()], "pos")
    raw = table(s, d, "orders").select(F.col("o_orderkey").alias("orig_idx"), (F.col("o_custkey") % 50).alias("cluster_id"))
    return files.gather(raw, picks, "orig_idx", "pos").select("pos", "orig_idx", "cluster_id")


@query("cache_decisions", """SELECT 'skip' AS subset, 'upgrade' AS superset, 'skip' AS overlapping, 'write' AS absent""")
def cache_decisions(s, d):
    k = table(s, d, "customer").select("c_custkey")
    half = k.where("c_custkey % 2 = 0")
    row = (
        files.cache_action(k, half, "c_custkey"), files.cache_action(half, k, "c_custkey"),
        files.cache_action(half, k.where("c_custkey % 3 = 0"), "c_custkey"), files.cache_action(None, k, "c_custkey"),
    )
    return s.createDataFrame([row], "subset string, superset string, overlapping string, absent string")


@query("recovery_budget", """WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 30 = 0 ORDER BY doc_id LIMIT 12), b AS (SELECT doc_id FROM documents WHERE doc_id % 20 = 0 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY doc_id LIMIT GREATEST(0, 20 - (SELECT count(*) FROM a)))
SELECT 'retrieval' AS stage, doc_id FROM a UNION ALL SELECT 'similarity', doc_id FROM b""")
def recovery_budget(s, d, budget=20):
    """Stages share one budget: each takes what is left, without what an earlier one took."""
    t = table(s, d, "documents").select("doc_id")
    first = t.where("doc_id % 30 = 0").orderBy("doc_id").limit(12)
    left = max(0, budget - first.count())
    second = t.where("doc_id % 20 = 0").join(first, "doc_id", "left_anti").orderBy("doc_id").limit(left)
    return first.select(F.lit("retrieval").alias("stage"), "doc_id").unionAll(second.select(F.lit("similarity").alias("stage"), "doc_id"))


@query("taxonomy_rows", """SELECT r_name AS broad, n_name AS category, dense_rank() OVER (ORDER BY r_regionkey) AS rank, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM region JOIN nation ON r_regionkey = n_regionkey""")
def taxonomy_rows(s, d):
    """A taxonomy document (JSON: broad groups with their members) as mapping rows with counts."""
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("members"))
    g = table(s, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.col("r_name").alias("name"), "members")
    doc = g.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "name", "members"))), lambda x: F.struct(x["name"].alias("name"), x["members"].alias("members")))).alias("j"))
    groups = doc.select(F.posexplode(F.from_json("j", "array<struct<name: string, members: array<string>>>")).alias("pos", "g"))
    rows = groups.select(F.col("g.name").alias("broad"), (F.col("pos") + 1).cast("long").alias("rank"), F.explode("g.members").alias("category"))
    counts = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("category")).agg(F.count("*").alias("n"))
    return R.one_to_one_left(rows, counts, ["category"]).select("broad", "category", "rank", F.coalesce("n", F.lit(0)).alias("n"))


@query("two_source_union", """SELECT 'supplier' AS src, s_suppkey AS item, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier UNION ALL SELECT 'part', p_partkey, (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY p_partkey) - 1 FROM part WHERE p_size > 45""")
def two_source_union(s, d):
    a = table(s, d, "supplier").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("item"), F.lit(0).alias("o"))
    b = table(s, d, "part").where("p_size > 45").select(F.lit("part").alias("src"), F.col("p_partkey").alias("item"), F.lit(1).alias("o"))
    return numbered(a.unionAll(b), ["o", "item"], "idx").select("src", "item", "idx")


@query("usage_histogram", """SELECT n AS usage, count(*) AS items FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY n""")
def usage_histogram(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("usage")).groupBy("usage").agg(F.count("*").alias("items"))


@query("universe_coverage", """WITH f AS (SELECT DISTINCT lower(p_type) AS l FROM part WHERE p_size < 10), u AS (SELECT DISTINCT lower(p_type) AS l FROM part WHERE p_size > 40)
SELECT (SELECT count(*) FROM u) AS universe, (SELECT count(*) FROM u WHERE l IN (SELECT l FROM f)) AS covered, (SELECT count(*) FROM u WHERE l NOT IN (SELECT l FROM f)) AS missing, (SELECT count(*) FROM f WHERE l NOT IN (SELECT l FROM u)) AS outside""")
def universe_coverage(s, d):
    p = table(s, d, "part").select(F.lower("p_type").alias("l"), "p_size")
    return V.coverage(p.where("p_size < 10"), p.where("p_size > 40"), "l")


@query("key_violations", """SELECT 'orders' AS t, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'customer', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'labels_fk', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)""")
def key_violations(s, d):
    count = lambda df, t: df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
    fk = V.foreign_key_violations(table(s, d, "labels"), table(s, d, "documents").where("doc_id % 2 = 0"), {"doc_id": "doc_id"})
    return (
        count(V.primary_key_violations(table(s, d, "orders"), ["o_custkey"]), "orders")
        .unionAll(count(V.primary_key_violations(table(s, d, "customer"), ["c_custkey"]), "customer")).unionAll(count(fk, "labels_fk"))
    )


@query("check_constraints", """SELECT 'quantity' AS rule, count(*) FILTER (WHERE NOT l_quantity <= 40) AS violations FROM lineitem UNION ALL SELECT 'status', count(*) FILTER (WHERE NOT l_linestatus IN ('O')) FROM lineitem""")
def check_constraints(s, d):
    return V.check_counts(table(s, d, "lineitem"), {"quantity": "l_quantity <= 40", "status": "l_linestatus IN ('O')"})


@query("manifest_agreement", """SELECT split, found, expected FROM (SELECT o_orderstatus AS split, count(*) AS found FROM orders GROUP BY 1) JOIN (SELECT o_orderstatus AS split, count(*) AS expected FROM orders WHERE o_orderkey % 100 <> 1 OR o_orderstatus <> 'F' GROUP BY 1) USING (split) WHERE found <> expected""")
def manifest_agreement(s, d):
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("split"), "o_orderkey")
    e = o.where("o_orderkey % 100 <> 1 OR split <> 'F'")
    return X.manifest_mismatches(X.manifest(o, "split", {}), X.manifest(e, "split", {}), "split")


@query("position_alignment", """SELECT count(*) AS rows, count(*) FILTER (WHERE pos < 0 OR pos >= 2000) AS out_of_range, count(*) - count(DISTINCT pos) AS repeated FROM (SELECT p_partkey % 1500 AS pos FROM part)""")
def position_alignment(s, d):
    p = table(s, d, "part").select((F.col("p_partkey") % 1500).alias("pos"))
    return p.agg(F.count("*").alias("rows"), F.count_if((F.col("pos") < 0) | (F.col("pos") >= 2000)).alias("out_of_range"), (F.count("*") - F.count_distinct("pos")).alias("repeated"))


@query("both_format_checks", """SELECT p_partkey, c AND k AND i AS format_ok, c AS has_categories, k AS has_keywords, c AND k AND i AS order_ok, contains(t, ';') AS has_semicolon, false AS has_special_token
FROM (SELECT p_partkey, t, contains(t, 'categories:') AS c, contains(t, 'keywords:') AS k, instr(t, 'keywords:') > instr(t, 'categories:') AS i
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'categories: a;b' || chr(10) || 'keywords: b' WHEN 1 THEN 'keywords: b categories: a' ELSE 'keywords: b' END AS t FROM part))""")
def both_format_checks(s, d):
    k = F.col("p_size") % 3
    t = F.when(k == 0, "Categories: a;b\nKeywords: b").when(k == 1, "Keywords: b Categories: a").otherwise("Keywords: b")
    return table(s, d, "part").select("p_partkey", parsing.both_output(t).alias("f")).select("p_partkey", "f.*")


@query("final_answers", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'highlight: ' || p_name ELSE '' END AS value, p_size % 4 < 2 AS ok,
CASE p_size % 4 WHEN 0 THEN 'prefix_found_later' WHEN 1 THEN 'missing_prefix_but_starts_with_highlight' WHEN 2 THEN 'empty_output' ELSE 'unclosed_think_block_likely_truncated' END AS note FROM part""")
def final_answers(s, d):
    k = F.col("p_size") % 4
    t = F.when(k == 0, F.concat(F.lit("so\n the correct ANSWER is:  "), "p_name")).when(k == 1, F.concat(F.lit("highlight: "), "p_name"))
    t = t.when(k == 2, " <|end|>").otherwise("<think> and then")
    return table(s, d, "part").select("p_partkey", parsing.final_answer(t).alias("f")).select("p_partkey", "f.*")


@query("category_answers", """SELECT p_partkey, p_brand AS value, p_brand IN ('Brand#1', 'Brand#3') AS ok, CASE WHEN p_brand IN ('Brand#1', 'Brand#3') THEN 'prefix_line' ELSE 'prefix_line;category_not_in_allowed_list' END AS note FROM part""")
def category_answers(s, d):
    t = F.concat(F.lit("Well.\nthe correct category is: `"), "p_brand", F.lit("`\nend"))
    return table(s, d, "part").select("p_partkey", parsing.category_answer(t, ["Brand#1", "Brand#3"]).alias("a")).select("p_partkey", "a.*")


@query("keyword_answers", """SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN '' ELSE p_name || ', ' || p_brand END AS value, p_size % 3 < 2 AS ok, CASE p_size % 3 WHEN 0 THEN 'prefix_line' WHEN 1 THEN 'missing_prefix_but_bare_keywords' ELSE 'missing_required_prefix' END AS note FROM part""")
def keyword_answers(s, d):
    k, words = F.col("p_size") % 3, F.concat("p_name", F.lit(" ;"), "p_brand")
    t = F.when(k == 0, F.concat(F.lit("The correct keywords are: "), words)).when(k == 1, words).otherwise(F.concat(F.lit("a\n"), words))
    return table(s, d, "part").select("p_partkey", parsing.keyword_answer(t).alias("a")).select("p_partkey", "a.*")


@query("evidence_block", """SELECT conv_id, string_agg('[Claim ' || rn || ']' || chr(10) || role || chr(10) || chr(10) || CASE WHEN rn = 2 THEN '[Retrieved evidence]' || chr(10) || 'No retrieved evidence.'
ELSE '[Evidence ' || rn || '.1]' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '[Evidence ' || rn || '.2]' || chr(10) || CAST(turn AS VARCHAR) END, chr(10) || chr(10) ORDER BY rn) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id""")
def evidence_block(s, d):
    c = table(s, d, "conversations").withColumn("claim_idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    one = lambda k, text: F.struct(F.lit(k).alias("rank"), text.alias("chunk_text"))
    found = F.array(one(1, F.coalesce("text", F.lit(""))), one(2, F.col("turn").cast("string")), one(3, F.lit("beyond")))
    evidence = F.when(F.col("claim_idx") != 2, F.slice(found, 1, 3)).otherwise(F.slice(found, 1, 0))
    claim = F.struct("claim_idx", F.col("role").alias("claim_sentence"), evidence.alias("evidence"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(claim)).alias("claims"))
    return g.select("conv_id", parsing.evidence_text(F.col("claims"), 2).alias("block"))


@query("tag_lists", """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) || '/t' || event_type AS tags FROM events""")
def tag_lists(s, d):
    """Tag structs from JSON, normalised and once each."""
    j = F.concat(F.lit('[{"id": "'), F.get_json_object("props", "$.k"), F.lit('"}, {"id": " t'), "event_type", F.lit('"}, {"id": "'), F.get_json_object("props", "$.k"), F.lit(' "}]'))
    tags = F.array_distinct(F.transform(F.from_json(j, "array<struct<id: string>>"), lambda x: F.struct(F.trim(x["id"]).alias("id"))))
    return table(s, d, "events").select("event_id", F.array_join(F.transform(tags, lambda x: x["id"]), "/").alias("tags"))


@query("token_span_roles", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE -1 END AS role FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem)""")
def token_span_roles(s, d):
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    q = F.col("l_quantity").cast("long")
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.array(pair(q, q + 1)).alias("t"))
    z = lambda v: F.lit(v).cast("long")
    spans = F.array(pair(z(0), z(10)), pair(z(10), z(30)))
    return li.select("l_orderkey", "l_linenumber", F.get(X.token_roles(F.col("t"), spans), F.lit(0)).cast("long").alias("role"))


@query("covering_selection")
def covering_selection(s, d):
    rows = curation.item_labels(s, d).select((F.col("user_id") % 3).alias("split"), "user_id", F.col("ls").alias("labels"))
    return C.cover_by_split(rows, "split", "user_id", "labels", 10)


@query("paragraphs")
def paragraphs(s, d):
    reflow = F.pandas_udf(C.paragraphs, "array<string>")
    return table(s, d, "documents").select("doc_id", F.posexplode(reflow("text")).alias("i", "paragraph"))


@query("representative_picks")
def representative_picks(s, d, total=60):
    """End to end: rank members by distance to their centroid, share a budget over the clusters,
    take each cluster's representatives."""
    from spindrift.operators import vectors as W

    ranked = W.centroid_ranks(curation.emb(s, d), "vec_id", "label", "embedding", curation.DIM)
    sizes = ranked.groupBy("label").agg(F.count("*").alias("size"))
    k = P.allocate(sizes, "label", "size", total, 20).select("label", "k")
    return W.gap_representatives(ranked.join(F.broadcast(k), "label").withColumnRenamed("k", "budget"), "vec_id", "label", F.col("budget"))


@query("homepage_counts", f"""WITH {serving.ARTICLES} SELECT broad_category, count(*) AS n, min(category_rank) AS category_rank FROM ready GROUP BY broad_category""")
def homepage_counts(s, d):
    return serving.ready(s, d).groupBy("broad_category").agg(F.count("*").alias("n"), F.min("category_rank").alias("category_rank"))


@query("loss_token_mean", "SELECT round(sum(l_tax * l_discount) / greatest(sum(l_discount), 1.0), 6) AS loss FROM lineitem WHERE l_quantity > 10")
def loss_token_mean(s, d):
    li = table(s, d, "lineitem").withColumn("m", F.col("l_quantity") > 10)
    return X.weighted_loss(li, "l_tax", "m", "l_discount", "l_orderkey", False).select(F.round("loss", 6).alias("loss"))


@query("terminal_suffix", """SELECT l_orderkey, list(CAST(l_linenumber AS INTEGER) ORDER BY l_linenumber)[-2:] = [2, 3] AS ends FROM lineitem GROUP BY 1""")
def terminal_suffix(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("int"))).alias("a"))
    return g.select("l_orderkey", S.ends_with(F.col("a"), [2, 3]).alias("ends"))


@query("target_text", r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || '.' WHEN 1 THEN p_name || ', b' ELSE 'News ' || p_name END AS target FROM part""")
def target_text(s, d):
    k = F.col("p_size") % 3
    t = F.when(k == 0, F.concat(F.lit("VIDEO: NEW -- \n tonight "), "p_name", F.lit(" .\n"))).when(k == 1, F.concat(F.lit("Watch| "), "p_name", F.lit(" ,  b")))
    return table(s, d, "part").select("p_partkey", T.target_text(t.otherwise(F.concat(F.lit("News "), "p_name"))).alias("target"))


@query("metric_summary", r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS summary, false AS legacy FROM conversations WHERE text NOT LIKE '%[%'""")
def metric_summary(s, d):
    c = table(s, d, "conversations").where("text NOT LIKE '%[%'")
    t = F.concat(F.lit("[SUMMARY]<|x|> Summary : "), "text", F.lit("\u3000[/SUMMARY]"))
    return c.select("conv_id", "turn", T.summary_for_metric(t).alias("summary"), T.has_legacy_tags(F.col("text")).alias("legacy"))


@query("metric_summary_whole")
def metric_summary_whole(s, d):
    """Every turn, those with brackets and tags too."""
    c = table(s, d, "conversations")
    t = F.concat(F.lit("[SUMMARY]<|x|> Summary : "), F.coalesce("text", F.lit("")), F.lit("\u3000[/SUMMARY]"))
    return c.select("conv_id", "turn", T.summary_for_metric(t).alias("summary"), T.has_legacy_tags(F.col("text")).alias("legacy"))


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&#x27;') AS safe FROM pages WHERE html NOT LIKE '%\'\'%'""".replace("\\'\\'", "''"))
def html_escape(s, d):
    return table(s, d, "pages").where("html NOT LIKE '%\\'%'").select("page_id", T.escape_html(F.col("html")).alias("safe"))


@query("html_escape_whole")
def html_escape_whole(s, d):
    """Every page, those with an apostrophe too."""
    return table(s, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("safe"))


@query("inference_rows", r"""SELECT doc_id, 'highlight' AS task, 'Article:' || chr(10) || text AS prompt FROM documents WHERE len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) >= 30 AND source IN ('src1', 'src2', 'src3')
UNION ALL SELECT doc_id, 'both', 'Allowed: a, b' || chr(10) || 'Title: ' || lang || chr(10) || 'Body: ' || text FROM documents WHERE len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) >= 30 AND source IN ('src1', 'src2', 'src3')""")
def inference_rows(s, d, least=30):
    """Rows for both generation tasks: allowed sections, a least length (in words here), prompts
    that pass their guard."""
    t = table(s, d, "documents").where(F.col("source").isin("src1", "src2", "src3") & (F.size(T.words(F.col("text"))) >= least))
    one = F.struct(F.lit("highlight").alias("task"), T.prompt_guard(T.highlight_prompt(F.col("text"))).alias("prompt"))
    two = F.struct(F.lit("both").alias("task"), T.category_prompt(F.col("lang"), F.col("text"), ["a", "b"]).alias("prompt"))
    return t.select("doc_id", F.explode(F.array(one, two)).alias("r")).select("doc_id", "r.task", "r.prompt")


@query("retrieval_status", """SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 300 THEN 'failed_chunk_build' WHEN lang = 'es' THEN 'failed_retrieval' WHEN doc_id % 50 = 3 THEN 'failed_packet_build' ELSE 'ok' END AS status FROM documents""")
def retrieval_status(s, d):
    st = F.when(F.col("text").isNull() | (F.length("text") < 300), "failed_chunk_build").when(F.col("lang") == "es", "failed_retrieval")
    return table(s, d, "documents").select("doc_id", st.when(F.col("doc_id") % 50 == 3, "failed_packet_build").otherwise("ok").alias("status"))


@query("retrieval_status_counts", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR length(text) < 300 THEN 'failed_chunk_build' WHEN lang = 'es' THEN 'failed_retrieval' WHEN doc_id % 50 = 3 THEN 'failed_packet_build' ELSE 'ok' END AS status FROM documents) GROUP BY 1""")
def retrieval_status_counts(s, d):
    return retrieval_status(s, d).groupBy("status").agg(F.count("*").alias("n"))


@query("two_stage_judge", """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'PASS' ELSE 'VERIFY' END AS s1 FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, quality FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(s1, 'none') AS stage1, CASE WHEN s1 = 'PASS' THEN 'OK' WHEN b.doc_id IS NULL THEN 'PARSE_FAILED' WHEN quality = 1 THEN 'REVISED' ELSE 'PARSE_FAILED' END AS final_status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def two_stage_judge(s, d):
    """Stage one passes or routes to stage two; results of both meet and a final status follows."""
    raw = F.when(F.col("doc_id") % 4 == 0, "pass").otherwise("Please verify\nRoute: both")
    one = table(s, d, "documents").where("doc_id % 2 = 0").select("doc_id", parsing.first_round(raw).alias("stage1"))
    two = table(s, d, "labels").select("doc_id", "quality")
    j = R.assemble_states(one, two, "doc_id", ["stage1"], ["quality"])
    final = F.when(F.col("stage1") == "PASS", "OK").when(F.col("quality") == 1, "REVISED").otherwise("PARSE_FAILED")
    return j.select("doc_id", F.coalesce("stage1", F.lit("none")).alias("stage1"), final.alias("final_status"))


@query("split_bundle", """WITH x AS (SELECT 'orders' AS src, o_orderkey AS item, o_orderstatus AS split FROM orders UNION ALL SELECT 'part', p_partkey, CASE WHEN p_size % 3 = 0 THEN 'F' ELSE 'O' END FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY src, split ORDER BY md5(CASE src WHEN 'orders' THEN '142:' ELSE '243:' END || item), item) AS rn FROM x) SELECT src, split, item FROM r WHERE rn <= 40""")
def split_bundle(s, d):
    """Two sources, a seeded take of each split, seeds offset by source."""
    o = table(s, d, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("split"), F.lit("142").alias("seed"))
    p = table(s, d, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 3 == 0, "F").otherwise("O").alias("split"), F.lit("243").alias("seed"))
    order = [F.md5(F.concat_ws(":", "seed", F.col("item").cast("string"))), F.col("item")]
    return R.top_per_group(o.unionAll(p), ["src", "split"], order, 40).select("src", "split", "item")


@query("member_inspection", f"""WITH {curation.CENT} SELECT vec_id, rank, round(sim, 6) AS sim FROM r WHERE label = 3 ORDER BY rank LIMIT 15""")
def member_inspection(s, d):
    from spindrift.operators import vectors as W

    r = W.centroid_ranks(curation.emb(s, d), "vec_id", "label", "embedding", curation.DIM).where("label = 3")
    return r.orderBy("rank").limit(15).select("vec_id", "rank", F.round("sim", 6).alias("sim"))


@query("token_lengths")
def token_lengths(s, d, path="/opt/tokenizers/byte_bpe_50k.json"):
    from spindrift.functions import tokens

    t = table(s, d, "documents")
    return t.select("doc_id", tokens.count_tokens(F.col("text"), path).alias("n"), tokens.truncate_tokens(F.col("text"), path, 20).alias("head"))


@query("unified_status", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'PARSE_FAILED' WHEN quality = 0 OR toxic = 1 THEN 'REVISED' ELSE 'OK' END AS status FROM labels""")
def unified_status(s, d):
    ok = F.when(F.col("doc_id") % 7 == 0, F.lit(False)).when(F.col("doc_id") % 2 == 0, F.lit(True))
    status = parsing.quality_status([F.col("quality") == 0, F.col("toxic") == 1], [ok, F.lit(None).cast("boolean")])
    return table(s, d, "labels").select("doc_id", status.alias("status"))


@query("text_embeddings", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), n AS (SELECT doc_id, CAST('0x' || left(md5(w), 6) AS BIGINT) % 32 AS dim, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM n""")
def text_embeddings(s, d):
    from spindrift.operators import embedding

    e = embedding.hashed_words(table(s, d, "documents"), "doc_id", "text", 32)
    return e.select("doc_id", "dim", F.round("weight", 6).alias("weight"))


@query("semantic_neighbours")
def semantic_neighbours(s, d):
    """Benchmark items' nearest documents by hashed embeddings."""
    from spindrift.operators import embedding, vectors

    docs = embedding.dense(embedding.hashed_words(table(s, d, "documents"), "doc_id", "text", 64), "doc_id", 64)
    items = embedding.dense(embedding.hashed_words(table(s, d, "benchmark"), "item_id", "text", 64), "item_id", 64)
    return vectors.knn(items.withColumnRenamed("item_id", "doc_id"), docs, "doc_id", "embedding", 3, include_self=True)


@query("trainer_features")
def trainer_features(s, d, path="/opt/tokenizers/byte_bpe_50k.json", limit=512):
    """Chat turns as trainer rows: the user's text is the prompt, the next turn the answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").withColumn("answer", F.lead("text").over(w)).where("role = 'user' AND answer IS NOT NULL")
    c = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), T.highlight_prompt(F.col("text")).alias("prompt"), "answer")
    return X.trainer_rows(c, "row_id", "prompt", "answer", path, limit)


@query("summary_features")
def summary_features(s, d, path="/opt/tokenizers/byte_bpe_50k.json"):
    """Chat turns as summary rows: a user's text is the article, the next turn the highlights."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").withColumn("answer", F.lead("text").over(w)).where("role = 'user' AND answer IS NOT NULL")
    c = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), "text", "answer")
    return Y.summary_features(c, "row_id", "text", "answer", path, limit=2048, article_tokens=1024)


@query("label_features")
def label_features(s, d, path="/opt/tokenizers/byte_bpe_50k.json"):
    """Benchmark items as label rows: their longest words are the keywords, the first of them the category."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 6))
    b = table(s, d, "benchmark").select("item_id", F.lit("Item").alias("title"), "text", words.alias("words"), F.slice(words, 1, 1).alias("first"))
    return Y.label_features(b, "item_id", "title", "text", "both", path, ["any"], "first", "words", limit=2048)
