"""Text, hash and array functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import parsing as P
from spindrift.functions import scalars as S
from spindrift.functions import text as T
from spindrift.operators import retrieval as Q
from spindrift.plans.registry import query
from spindrift.sources.tables import table

WORDS = "list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query("highlight_clean", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split('NEW: ' || coalesce(text, ''), chr(10)),
  lambda x: trim(x)), lambda x: x <> ''), ' '), '^(?i:\s*(?:VIDEO|WATCH|NEW\s*:|NEW:|NEW\s*[-–—])\s*)+', ''), '\s+', ' ', 'g')) AS cleaned FROM documents""")
def highlight_clean(s, d):
    return docs(s, d).select("doc_id", T.clean_highlights(F.concat(F.lit("NEW: "), F.coalesce("text", F.lit("")))).alias("cleaned"))


@query("word_slice", f"SELECT doc_id, array_to_string({WORDS}[3:6], ' ') AS part, array_to_string({WORDS}[5:], ' ') AS rest FROM documents")
def word_slice(s, d):
    return docs(s, d).select("doc_id", T.word_slice(F.col("text"), 3, 6).alias("part"), T.word_slice(F.col("text"), 5, 0).alias("rest"))


@query("first_words", f"SELECT doc_id, array_to_string({WORDS}[1:12], ' ') AS head FROM documents")
def first_words(s, d):
    return docs(s, d).select("doc_id", T.first_words(F.col("text"), 12).alias("head"))


@query("head_tail_words", f"""SELECT doc_id, array_to_string(w[1:CAST(least(len(w), greatest(1, ceil(len(w) * 0.25))) AS INTEGER)], ' ') AS head,
  array_to_string(w[CAST(greatest(1, len(w) - least(len(w), greatest(1, ceil(len(w) * 0.25))) + 1) AS INTEGER):], ' ') AS tail FROM (SELECT doc_id, {WORDS} AS w FROM documents)""")
def head_tail(s, d):
    return docs(s, d).select("doc_id", T.head_words(F.col("text"), 0.25).alias("head"), T.tail_words(F.col("text"), 0.25).alias("tail"))


@query("first_fraction_chars", """SELECT doc_id, left(text, CAST(greatest(1, ceil(length(text) * 0.1)) AS INTEGER)) AS part, trim(left(text, 20)) AS short FROM documents""")
def first_fraction(s, d):
    return docs(s, d).select("doc_id", T.first_fraction(F.col("text"), 0.1).alias("part"), T.truncate_chars(F.col("text"), 20).alias("short"))


@query("representation_text", f"""SELECT doc_id, 'Title: ' || trim(regexp_replace(left(text, 10), '\\s+', ' ', 'g')) || CASE WHEN lang = 'en' THEN '' ELSE ' | Categories: ' || lang END || ' | Keywords: ' || source || '; ' || lang
  || ' | Body: ' || array_to_string({WORDS}[1:5], ' ') AS repr FROM (SELECT * FROM documents)""")
def representation(s, d):
    t = docs(s, d)
    cats = F.when(F.col("lang") != "en", F.array("lang")).otherwise(F.array().cast("array<string>"))
    return t.select("doc_id", T.representation(F.left("text", F.lit(10)), cats, F.array("source", "lang"), T.first_words(F.col("text"), 5)).alias("repr"))


@query("representation_text_whole")
def representation_whole(s, d):
    """Every document: its first line as title, its whole text as body."""
    t = docs(s, d)
    text = F.coalesce("text", F.lit(""))
    cats = F.when(F.col("lang") != "en", F.array("lang")).otherwise(F.array().cast("array<string>"))
    keys = F.array_compact(F.array("source", "lang"))
    return t.select("doc_id", T.representation(F.substring_index(text, "\n", 1), cats, keys, text).alias("repr"))


@query("label_normalize", r"SELECT p_partkey, regexp_replace(p_brand || CASE WHEN p_size % 2 = 0 THEN 'special' ELSE '' END || p_size, '^(.*special)\d+$', '\1') AS label FROM part")
def label_normalize(s, d):
    p = table(s, d, "part")
    raw = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "special").otherwise(""), F.col("p_size").cast("string"))
    return p.select("p_partkey", T.normalize_label(raw).alias("label"))


@query("boolean_flags", "SELECT o_orderkey, lower(trim(o_orderstatus)) IN ('f', 'o') AS flag FROM orders")
def boolean_flags(s, d):
    return table(s, d, "orders").select("o_orderkey", T.is_true(F.col("o_orderstatus"), ("f", "o")).alias("flag"))


@query("keyword_split", r"""WITH p AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || ', ' || upper(p_name) || ';x|y', '[,;|]\s*'), lambda x: trim(x)), lambda x: x <> '') AS k FROM part)
SELECT p_partkey, array_to_string(list_filter(k, lambda x, i: NOT list_contains(list_transform(k[1:i - 1], lambda y: lower(y)), lower(x))), '/') AS keywords FROM p""")
def keyword_split(s, d):
    raw = F.concat(F.col("p_name"), F.lit(", "), F.upper("p_name"), F.lit(";x|y"))
    return table(s, d, "part").select("p_partkey", F.array_join(T.split_keywords(raw), "/").alias("keywords"))


@query("item_split", r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,;\n]+'), lambda x: trim(x)), lambda x: x <> ''), ', ') AS items FROM documents""")
def item_split(s, d):
    return docs(s, d).select("doc_id", T.join_items(T.split_items(F.col("text"))).alias("items"))


@query("combination_normalize", r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(regexp_replace('  ' || p_type || ' ,' || p_brand || '|  ' || p_name, '\s+', ' ', 'g'))), '\s*,\s*', ', ', 'g'), '\s*\|\s*', '|', 'g') AS combo FROM part""")
def combination(s, d):
    raw = F.concat(F.lit("  "), "p_type", F.lit(" ,"), "p_brand", F.lit("|  "), "p_name")
    return table(s, d, "part").select("p_partkey", T.normalize_combination(raw).alias("combo"))


@query("special_tokens", r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS plain, regexp_replace(text, '^\s+|\s+$', '', 'g') AS visible FROM conversations""")
def special_tokens(s, d):
    t = F.col("text")
    return table(s, d, "conversations").select(
        "conv_id", "turn", P.without_tokens(F.concat(F.lit(" <|im_start|>"), t, F.lit("<|end|> "))).alias("plain"),
        P.without_thinking(F.concat(F.lit("<think>a\nb</Think> "), t, F.lit(" </think>"))).alias("visible"),
    )


@query("claim_split", r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '^(?i:highlight:)', ''), '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cs FROM documents)
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS claim_idx, cs[pos] AS claim FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS pos FROM c)""")
def claim_split(s, d):
    return Q.claim_jobs(docs(s, d), "doc_id", "text")


#: Sentences of an article as SQL: white space collapsed, broken before minute markers and after
#: sentence ends.
SENTENCES = rf"""list_transform(flatten(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '(?i) ({T.MINUTE})', chr(2) || '\1', 'g'), chr(2)),
  lambda b: string_split(regexp_replace(trim(b), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x))"""


@query("article_sentences", f"""WITH c AS (SELECT doc_id, {SENTENCES} AS ss FROM documents)
SELECT doc_id, CAST(len(list_filter(ss, lambda x: len(string_split(x, ' ')) >= 3)) AS BIGINT) AS n FROM c""")
def article_sentences(s, d):
    return docs(s, d).select("doc_id", F.size(T.article_sentences(F.col("text"))).cast("long").alias("n"))


@query("response_changed", r"""SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) <> lower(trim(regexp_replace(upper(text) || ' ', '\s+', ' ', 'g'))) AS changed FROM conversations""")
def response_changed(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", (T.comparable(F.col("text")) != T.comparable(F.concat(F.lit("Highlight: "), F.upper("text"), F.lit(" ")))).alias("changed"))


@query("response_changed_whole")
def response_changed_whole(s, d):
    """Every turn, whatever its letters or its opening."""
    c = table(s, d, "conversations")
    other = F.concat(F.lit("Highlight: "), F.upper("text"), F.lit(" "))
    return c.select("conv_id", "turn", (T.comparable(F.col("text")) != T.comparable(other)).alias("changed"))


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("repetition_flags", f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
g AS (SELECT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM t, (VALUES (3), (4)) v(n)) WHERE i + n - 1 <= len(w)),
c AS (SELECT doc_id, n, count(*) AS c FROM g GROUP BY doc_id, n, k)
SELECT doc_id, coalesce(max(CASE WHEN n = 3 THEN c END) >= 3, false) AS trigram, coalesce(max(CASE WHEN n = 4 THEN c END) >= 2, false) AS fourgram FROM t LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def repetition(s, d):
    return T.with_repetition(docs(s, d), "text").select("doc_id", "trigram", "fourgram")


@query("field_payloads", """SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ','), lambda x: trim(x)), '/') AS categories, p_name || '/' || p_brand AS keywords FROM part""")
def field_payloads(s, d):
    t = F.concat(F.lit("Categories: "), "p_type", F.lit("\nKEYWORDS: "), "p_name", F.lit(" ;\n"), "p_brand", F.lit("<|end|>"))
    f = P.generated_fields(t)
    return table(s, d, "part").select("p_partkey", F.array_join(f["categories"], "/").alias("categories"), F.array_join(f["keywords"], "/").alias("keywords"))


VERDICT = "CASE conv_id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN ' **Verify** it' WHEN 2 THEN 'pass, or verify' WHEN 3 THEN '' ELSE 'hm ' || role END"


def verdicts(s, d):
    k = F.col("conv_id") % 5
    v = F.when(k == 0, "PASS").when(k == 1, " **Verify** it").when(k == 2, "pass, or verify").when(k == 3, "").otherwise(F.concat(F.lit("hm "), "role"))
    return table(s, d, "conversations").select("conv_id", "turn", "role", v.alias("v"))


@query("verdict_status", f"""SELECT conv_id, turn, CASE WHEN contains(l, 'VERIFY') THEN 'VERIFY' WHEN contains(l, 'PASS') THEN 'PASS' ELSE 'VERIFY' END AS status FROM (SELECT conv_id, turn, regexp_replace(upper({VERDICT}), '[^A-Z]', '', 'g') AS l FROM conversations)""")
def verdict_status(s, d):
    return verdicts(s, d).select("conv_id", "turn", P.first_round(F.col("v")).alias("status"))


@query("verdict_crosstab", f"""SELECT role, count(*) FILTER (WHERE s = 'PASS') AS passed, count(*) FILTER (WHERE s = 'VERIFY') AS verify FROM (SELECT role, CASE WHEN contains(l, 'VERIFY') THEN 'VERIFY' WHEN contains(l, 'PASS') THEN 'PASS' ELSE 'VERIFY' END AS s
  FROM (SELECT role, regexp_replace(upper({VERDICT}), '[^A-Z]', '', 'g') AS l FROM conversations)) GROUP BY role""")
def verdict_crosstab(s, d):
    x = verdicts(s, d).select("role", P.first_round(F.col("v")).alias("s"))
    p = x.groupBy("role").pivot("s", ["PASS", "VERIFY"]).count().fillna(0)
    return p.select("role", F.col("PASS").alias("passed"), F.col("VERIFY").alias("verify"))


@query("word_universe", """WITH w AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[&''./-][A-Za-z0-9]+)*'), lambda x: lower(x)))) AS w FROM documents)
SELECT DISTINCT w FROM w WHERE lang = 'en' AND w NOT IN (SELECT w FROM w WHERE lang <> 'en')""")
def word_universe(s, d):
    w = docs(s, d).select("lang", F.explode(T.word_candidates(F.col("text"))).alias("w"))
    return w.where("lang = 'en'").select("w").distinct().join(w.where("lang <> 'en'").select("w").distinct(), "w", "left_anti")


@query("payload_items", r"""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_type || ';' || p_name || ',' || p_brand, '[,;\n\t]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part""")
def payload_items(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(T.payload_items(F.concat("p_type", F.lit(";"), "p_name", F.lit(",") , "p_brand")), "|").alias("items"))


@query("answer_labels", r"""SELECT n_nationkey, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract('Categories: ' || n_name || ' | b;c', '(?is)categories\s*:\s*([^\n]*)', 1), '[,|;]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS labels FROM nation""")
def answer_labels(s, d):
    return table(s, d, "nation").select("n_nationkey", F.array_join(P.labels_of_answer(F.concat(F.lit("Categories: "), "n_name", F.lit(" | b;c"))), "/").alias("labels"))


@query("cycling_separators", """SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN x ELSE [', ', '; ', ' / '][1 + (i - 2) % 3] || x END), '') AS joined FROM (SELECT doc_id, """ + WORDS + """ AS w FROM documents)""")
def cycling(s, d):
    return docs(s, d).select("doc_id", T.cycling_join(T.words(F.col("text")), [", ", "; ", " / "]).alias("joined"))


@query("url_redaction", r"""SELECT page_id, regexp_replace(url, '([?&]ref=)[^&#]*', '\1REDACTED', 'g') AS url, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM pages""")
def url_redaction(s, d):
    return table(s, d, "pages").select("page_id", T.redact_parameter(F.col("url"), "ref").alias("url"), T.safe_filename(F.col("url")).alias("file"))


@query("short_dates", """SELECT o_orderkey, strftime(o_orderdate, '%b ') || CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ', %Y') AS date FROM orders""")
def short_dates(s, d):
    return table(s, d, "orders").select("o_orderkey", T.short_date(F.col("o_orderdate")).alias("date"))


@query("first_non_blank", """SELECT doc_id, coalesce(nullif(trim(left(text, 0)), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN source END), ''), nullif(trim(lang), ''), '') AS value,
  CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'lang' END AS provenance FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def first_non_blank(s, d):
    src = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return docs(s, d).where("source IS NOT NULL AND lang IS NOT NULL").select(
        "doc_id", T.first_text(F.lit(""), src, F.col("lang")).alias("value"), F.when(src.isNotNull(), "source").otherwise("lang").alias("provenance")
    )


@query("event_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id || ':' || event_type AS name FROM events""")
def event_props(s, d):
    e = table(s, d, "events").withColumn("p", F.from_json("props", "struct<k: long>"))
    return e.select("event_id", F.col("p.k").alias("k"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("name"))


@query("digests", r"""SELECT doc_id, sha256('model-a' || chr(10) || '64' || chr(10) || text) AS vector_hash, left(md5(source || '|||' || lang), 16) AS fallback,
  sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS canonical FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def digests(s, d):
    return docs(s, d).where("source IS NOT NULL AND lang IS NOT NULL").select(
        "doc_id", S.vector_hash(F.col("text"), "model-a", 64).alias("vector_hash"), S.fallback_id(F.col("source"), F.col("lang")).alias("fallback"),
        S.canonical_hash(source=F.col("source"), lang=F.col("lang")).alias("canonical"),
    )


@query("ids_digest", r"""SELECT source, sha1(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents WHERE source IS NOT NULL GROUP BY source""")
def ids_digest(s, d):
    g = docs(s, d).where("source IS NOT NULL").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return g.select("source", S.ids_digest(F.col("ids")).alias("digest"))


@query("rank_weights", """SELECT o_orderkey, l_linenumber, round(CASE WHEN n > 1 THEN 1.0 + 0.3 * pow((l_linenumber - 1) / (n - 1), 2.0) ELSE 1.3 END, 9) AS weight, round(2.4 / pow(n, 0.5), 9) AS per_token
FROM (SELECT l_orderkey AS o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= l_linenumber""")
def rank_weights(s, d):
    from pyspark.sql import Window

    w = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    return w.where("n >= l_linenumber").select(
        "o_orderkey", "l_linenumber", F.round(S.rank_weight(F.col("l_linenumber"), F.col("n"), 1.0, 0.3, 2.0), 9).alias("weight"),
        F.round(S.token_weight(F.lit(2.4), F.col("n"), "power"), 9).alias("per_token"),
    )


@query("schedule", """SELECT event_id, round(CASE WHEN p <= 0 THEN 0.04 WHEN p >= 0.8 THEN 0.01 ELSE 0.04::DOUBLE + -0.03::DOUBLE * least(floor(p / 0.8::DOUBLE / 0.01::DOUBLE), 99) / 99 END, 9) AS weight FROM (SELECT event_id, (event_id % 1000) / 1000.0::DOUBLE AS p FROM events)""")
def schedule(s, d):
    return table(s, d, "events").select("event_id", F.round(S.binned_schedule((F.col("event_id") % 1000) / F.lit(1000.0), 0.04, 0.01, 0.0, 0.8, 0.01), 9).alias("weight"))


@query("item_set_scores", f"""WITH t AS (SELECT doc_id, list_distinct({WORDS}) AS g, list_distinct({WORDS}[3:]) AS p FROM documents),
h AS (SELECT doc_id, len(g) AS ng, len(p) AS np, len(list_intersect(g, p)) AS k FROM t),
r AS (SELECT doc_id, CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN np > 0 THEN k / np ELSE 0.0 END AS precision, CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN ng > 0 THEN k / ng ELSE 0.0 END AS recall, k = ng AND k = np AS exact FROM h)
SELECT doc_id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1, exact FROM r""")
def item_scores(s, d):
    w = T.words(F.col("text"))
    x = docs(s, d).select("doc_id", S.item_scores(w, F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(0)))).alias("s"))
    return x.select("doc_id", F.round("s.precision", 9).alias("precision"), F.round("s.recall", 9).alias("recall"), F.round("s.f1", 9).alias("f1"), "s.exact")


@query("object_uuid")
def object_uuid(s, d):
    return docs(s, d).select("doc_id", S.object_uuid(F.concat(F.lit("article:"), F.col("doc_id").cast("string"))).alias("uuid"))


@query("stable_probability")
def stable_probability(s, d):
    key = F.concat_ws("|", F.lit("42"), F.lit("train"), F.col("doc_id").cast("string"), F.lit("extra"))
    return docs(s, d).select("doc_id", S.stable_unit(key).alias("u")).where("u < 0.25")
