"""Sentence chunks, claims, hybrid search, evidence packets, reranking and recommendations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T


def sentence_chunks(articles: DataFrame, id_col: str, text_col: str, overlap: float = 0.0) -> DataFrame:
    """One chunk per sentence, searched with the tail of the one before and the head of the one
    after (``overlap`` of their words), and where it stands in the raw text."""
    s = articles.select(id_col, text_col, T.article_sentences(F.col(text_col)).alias("ss"))
    s = s.withColumn("spans", char_spans(F.coalesce(F.col(text_col), F.lit("")), F.col("ss")))
    c = s.select(id_col, "ss", "spans", F.posexplode("ss").alias("i", "sentence"))
    around = lambda k, f: neighbour_part(F.get("ss", F.col("i") + k), f, overlap)
    parts = F.filter(F.array(around(-1, T.tail_words), F.col("sentence"), around(1, T.head_words)), lambda x: x != "")
    return c.select(
        id_col, F.concat(F.col(id_col).cast("string"), F.lit("::sent::"), F.col("i").cast("string")).alias("chunk_id"),
        F.col("i").cast("long").alias("sentence_id"), F.col("sentence").alias("chunk_text"), F.array_join(parts, " ").alias("search_text"),
        F.get("spans", F.col("i"))["start"].alias("start_char"), F.get("spans", F.col("i"))["end"].alias("end_char"),
        T.minute_marker(F.col("sentence")).alias("minute_marker"), F.lit(overlap).alias("overlap_ratio"),
    )


def neighbour_part(sentence: Column, part: Callable[[Column, float], Column], ratio: float) -> Column:
    """A fraction of a neighbouring sentence, empty where there is none."""
    return F.when(sentence.isNotNull(), part(sentence, ratio)).otherwise(F.lit(""))


def char_spans(text: Column, sentences: Column) -> Column:
    """Where each sentence stands in the raw text, searched onwards from the last one found; not
    found is (-1, -1) and leaves the cursor."""

    def step(acc: Column, s: Column) -> Column:
        found = F.position(s, text, acc["at"] + 1)
        span = F.struct((found - 1).alias("start"), (found - 1 + F.length(s)).alias("end"))
        none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
        return F.struct(
            F.when(found > 0, found - 1 + F.length(s)).otherwise(acc["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.when(found > 0, span).otherwise(none))).alias("out"),
        )

    return F.aggregate(sentences, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step, lambda a: a["out"])


def claim_jobs(samples: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One job per claim sentence, numbered from 0."""
    c = samples.select(id_col, F.posexplode(T.claim_sentences(F.col(text_col))).alias("i", "claim"))
    return c.select(id_col, F.col("i").cast("long").alias("claim_idx"), "claim")


def checked_jobs(jobs: DataFrame, claim: str, vec: str, dim: int) -> DataFrame:
    """``jobs`` with ``error``: why a job can't be searched, else null.  A failed job stays a row, so
    the others are searched and no failure is lost."""
    v = F.col(vec)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    error = (
        F.when(F.trim(F.coalesce(F.col(claim), F.lit(""))) == "", "empty claim").when(v.isNull(), "no vector")
        .when(F.size(v) != dim, F.concat(F.lit("vector of "), F.size(v).cast("string"), F.lit(f" for {dim}"))).when(odd, "vector not finite")
    )
    return jobs.withColumn("error", error)


def term_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf, len): lower-cased ASCII word terms of each row."""
    t = df.select(*keys, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    n = F.size("w").cast("long").alias("len")
    return t.select(*keys, n, F.explode("w").alias("term")).groupBy(*keys, "len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, doc_key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score): BM25 of every pair that shares a term, by a join on terms."""
    d = term_counts(docs, [doc_key], text)
    stats = docs.select(F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("l")).agg(
        F.count("*").alias("n"), F.avg("l").alias("avg_len")
    )
    df = d.groupBy("term").agg(F.count("*").alias("df"))
    q = term_counts(queries, [query_key], query_text).select(query_key, "term").distinct()
    hit = q.join(df, "term").join(d, "term").join(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hit.groupBy(query_key, doc_key).agg(F.round(F.sum(part), 9).alias("score"))


def scaled(df: DataFrame, group: str, score: str, out: str) -> DataFrame:
    """Min-max scaled scores inside each group; a group of equal scores gets 1."""
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(F.lit(1.0)))


def hybrid(vector: DataFrame, keyword: DataFrame, query: str, doc: str, alpha: float = 0.7, limit: int = 8, least: float | None = None) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword over scaled scores; the best ``limit`` per query.
    A null score passes the least-score filter."""
    v = scaled(vector, query, "score", "v").select(query, doc, "v")
    k = scaled(keyword, query, "score", "k").select(query, doc, "k")
    j = v.join(k, [query, doc], "full_outer")
    fused = F.round(F.lit(alpha) * F.coalesce("v", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("k", F.lit(0.0)), 9)
    j = j.withColumn("score", fused)
    if least is not None:
        j = j.where(F.col("score").isNull() | (F.col("score") >= least))
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), doc)
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).select(query, doc, "score", "rank")


def evidence_packets(claims: DataFrame, evidence: DataFrame, sample: str, top_n: int) -> DataFrame:
    """One packet per sample: its claims in order, each with its best evidence (maybe none)."""
    e = evidence.where(F.col("rank") <= top_n).groupBy(sample, "claim_idx").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))).alias("evidence"))
    j = claims.join(e, [sample, "claim_idx"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<rank:bigint,doc:bigint,score:double>>")))
    return j.groupBy(sample).agg(F.sort_array(F.collect_list(F.struct("claim_idx", "claim", "evidence"))).alias("claims"))


def confident(rows: DataFrame, score: str, least: float) -> DataFrame:
    """Rows whose score, null being 0, reaches a threshold."""
    return rows.where(F.coalesce(F.col(score), F.lit(0.0)) >= least)


def recommendation_records(
    queries: DataFrame, found: DataFrame, query: str, item: str, order: list[Column], cap: int = 10, status: str | None = None
) -> DataFrame:
    """One row per query, even without results: ordered ids, never itself, once each, capped;
    with ``status``, only results whose status is ok."""
    f = found.where(F.col(query) != F.col(item))
    if status:
        f = f.where(F.lower(F.trim(status)) == "ok")
    once = Window.partitionBy(query, item).orderBy(*order)
    f = f.withColumn("_o", F.row_number().over(once)).where("_o = 1")
    w = Window.partitionBy(query).orderBy(*order, F.col(item))
    f = f.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    g = f.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", item))), lambda x: x[item]).alias("recommended"))
    return queries.select(query).distinct().join(g, query, "left").withColumn("recommended", F.coalesce("recommended", F.array().cast("array<bigint>")))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query vector its best inner product with the document's, summed."""

    @F.pandas_udf("double")
    def score(q: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([float((np.stack(list(a)) @ np.stack(list(b)).T).max(1).sum()) if len(a) and len(b) else 0.0 for a, b in zip(q, x, strict=True)])

    return score(query, doc)


def max_sim_sets(vectors: DataFrame, set_col: str, id_col: str, vec_col: str, block: int = 2048) -> DataFrame:
    """(q, doc, score): ``max_sim`` of every two different sets, all their vectors included.

    Blocks of one set each meet as matrix products; a pair of blocks gives each query vector's
    best, and the largest of these over all blocks of the other set is summed.  Work is rows x rows.
    """
    sizes = vectors.groupBy(F.col(set_col).alias("q")).agg(F.ceil(F.count("*") / block).alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 1
    rows = vectors.select(F.col(set_col).alias("q"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.join(F.broadcast(sizes), "q").withColumn("block", F.pmod(F.xxhash64("id"), "n"))
    a = rows.groupBy("q", "block").agg(F.collect_list("id").alias("qi"), F.flatten(F.collect_list("v")).alias("qm"))
    a = a.repartition(min(n, 32))  # blocks, not rows
    b = a.select(F.col("q").alias("doc"), F.col("qm").alias("bm"), F.size("qi").alias("bn"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                qi, qm, bm = (np.asarray(batch.column(c)[row].values) for c in ("qi", "qm", "bm"))
                q = qm.reshape(len(qi), -1)[np.argsort(qi, kind="stable")]
                best = (q @ bm.reshape(batch.column("bn")[row].as_py(), -1).T).max(1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, 1) for c in ("q", "block", "doc")), pa.array([best], pa.list_(pa.float64()))], names=["q", "block", "doc", "best"]
                )

    kinds = {f.name: f.dataType.simpleString() for f in a.schema}
    pairs = a.crossJoin(b).where("q <> doc")
    best = pairs.mapInArrow(run, f"q {kinds['q']}, block {kinds['block']}, doc {kinds['q']}, best array<double>")

    @F.pandas_udf("double")
    def total(x: pd.Series) -> float:
        return float(np.maximum.reduce(list(x)).sum())

    per_block = best.groupBy("q", "block", "doc").agg(total("best").alias("s"))
    return per_block.groupBy("q", "doc").agg(F.sum("s").alias("score"))


def transport_score(a: np.ndarray, b: np.ndarray) -> float:
    """1 - the cost of moving uniform mass between two sets of unit vectors, the cost being cosine
    distance clamped to [0, 1]; both empty is 1, one empty 0.  Exact, by successive shortest
    paths on integer masses."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    cost = np.clip(1 - a @ b.T, 0, 1)
    supply, demand = np.full(n, m), np.full(m, n)  # n * m units in all
    flow = np.zeros((n, m), np.int64)
    while supply.sum():
        dist, prev = np.where(supply > 0, 0.0, np.inf), np.full(n, -1)
        dj, pj = np.full(m, np.inf), np.full(m, -1)
        for _ in range(n + m):  # Bellman-Ford on the residual graph
            via = dist[:, None] + cost
            new = via.min(0)
            better = new < dj - 1e-12
            if not better.any():
                break
            dj[better], pj[better] = new[better], via.argmin(0)[better]
            back = np.where(flow > 0, dj[None, :] - cost, np.inf)
            low = back.min(1)
            step = low < dist - 1e-12
            dist[step], prev[step] = low[step], back.argmin(1)[step]
        j = int(np.where(demand > 0, dj, np.inf).argmin())
        path, end = [], j
        while True:
            i = int(pj[j])
            path.append((i, j))
            if prev[i] < 0:
                break
            j = int(prev[i])
            path.append((i, j))
        units = min(int(supply[i]), int(demand[end]), *(int(flow[x]) for x in path[1::2]))
        for k, x in enumerate(path):
            flow[x] += units if k % 2 == 0 else -units
        supply[i] -= units
        demand[end] -= units
    return float(1 - (flow * cost).sum() / (n * m))


def mover_score(predicted: Column, reference: Column) -> Column:
    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        stack = lambda x: np.stack([np.asarray(v, float) for v in x]) if len(x) else np.zeros((0, 1))
        return pd.Series([transport_score(stack(a), stack(b)) for a, b in zip(p, r, strict=True)])

    return score(predicted, reference)
