"""Search in blocks: what tasks keep and send, against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from spindrift.operators import search as K
from spindrift.plans.catalog import QUERIES

WORDS = "the of and to in red blue green stone river".split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    out = [" ".join(rng.choice(WORDS[: 3 + k % 8], 4 + k % 9)) for k in range(40)]
    return [*out, None, "", "The the THE, of!", out[3], out[3]]


def scores(texts, asked):
    """BM25 of each text that shares a term."""
    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    tf, df = [Counter(w) for w in words], Counter(x for w in words for x in set(w))
    known = [len(w) for w, t in zip(words, texts, strict=True) if t is not None]
    avg, n = sum(known) / len(known), len(texts)
    idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in set(re.findall("[a-z0-9]+", (asked or "").lower())) if df[w]}
    part = lambda c, w, size: idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / avg))
    return {k: sum(part(c, w, len(words[k])) for w in idf if w in c) for k, c in enumerate(tf) if set(idf) & set(c)}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_top(spark, texts, monkeypatch):
    monkeypatch.setattr(K, "DOCS", 7)
    monkeypatch.setattr(K, "QUERIES", 2)
    asks = ["the river", "Stone, stone blue", "nothing", None, "of the and red", "green"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string").repartition(3)
    got = {}
    for r in K.bm25_top(docs, "d", "t", spark.createDataFrame(list(enumerate(asks)), "i long, t string"), "i", "t", 5).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["doc"], r["score"]))
    for k, ask in enumerate(asks):
        s = {d: round(x, 6) for d, x in scores(texts, ask).items()}
        best = sorted(s, key=lambda d: (-math.floor(s[d] * 1e5 + 0.5), d))[:5]
        assert got.get(k, []) == [(d, pytest.approx(s[d], abs=1e-9)) for d in best]


def test_hybrid_top(spark, texts, monkeypatch):
    """A vector without a document, a document without a vector, no first sentence, equal rows."""
    monkeypatch.setattr(K, "DOCS", 7)
    monkeypatch.setattr(K, "QUERIES", 2)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((len(texts) + 1, 4))
    x[-2] = x[-3]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id long, v array<double>").repartition(3)
    docs = spark.createDataFrame([*enumerate(texts), (500, "the river stone")], "d long, t string").repartition(3)
    asks = {0: "the river", 5: "Stone, stone blue", 9: None, 11: "nothing", len(texts): "of the"}
    queries = spark.createDataFrame([(k, x[k].tolist(), t) for k, t in asks.items()], "id long, v array<double>, said string")
    got = {}
    for r in K.hybrid_top(vectors, "id", "v", docs, "d", "t", queries, "said").orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["doc"], r["score"]))
    scale = lambda s: {k: (v - min(s.values())) / (max(s.values()) - min(s.values())) if max(s.values()) > min(s.values()) else 1.0 for k, v in s.items()}
    for q, ask in asks.items():
        v = scale({k: float(x[q] @ x[k]) for k in range(len(x)) if k != q})
        hits = {k: s for k, s in scores(texts, ask).items() if k != q}
        k = scale(hits) if hits else {}
        s = {d: round(0.7 * v[d] + 0.3 * k.get(d, 0), 8) for d in v}
        best = sorted(s, key=lambda d: (-s[d], d))[:8]
        assert got[q] == [(d, pytest.approx(s[d], abs=1e-7)) for d in best]


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_search_whole", "confident_topics_whole", "recommendation_records_whole", "evidence_packets_whole"])
def test_no_row_for_a_pair(spark, sf_dir, name):
    """Terms aren't exploded and pairs aren't joined: tasks send what they keep."""
    p = plan(QUERIES[name](spark, sf_dir))
    assert "MapInArrow" in p and "explode(w" not in p and "Join Cross" in p.replace("Join Inner, leftHint=(strategy=shuffle_replicate_nl)", "Join Cross")


def test_array_overlap_meets_blocks(spark, tmp_path):
    """Users of one kind meet as blocks; no null user or type matches."""
    rows = [(k * 77, k % 60, ["a", "b", "c", None][k // 60 % 4]) for k in range(400)] + [(k * 7, None if k % 50 == 0 else k % 90, "ab"[k % 2]) for k in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    kinds = lambda m: {u: {t for i, v, t in rows if v == u and i % m == 0 and t} for u in {v for i, v, _ in rows if v is not None and i % m == 0}}
    want = sorted((u, v) for u, x in kinds(7).items() for v, y in kinds(11).items() if u % 10 == v % 10 and x & y)
    df = QUERIES["array_overlap"](spark, str(tmp_path))
    assert want and sorted(map(tuple, df.collect())) == want
    assert "shuffle_replicate_nl" in plan(df) and "Generate" in plan(df)
