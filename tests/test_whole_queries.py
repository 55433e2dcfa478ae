"""Queries over whole tables that SQL can't hold, against brute force on texts their SQL sisters leave out."""

import hashlib
import html
import math
import re
from collections import Counter

import numpy as np
import pytest

from spindrift.plans.catalog import ORACLES, QUERIES

TEXTS = [
    " leading space  here", "Straße und Fluß.", "STRASSE", "Highlight: it's é", "\u00a0highlight : ÉA b", "[SUMMARY] tagged [x] 'y'", "summary: [TASK=SUMMARY] z",
    "<|end|> it's <b>\"bold\"</b> & more", "The same thirty characters opening, then one.", "The same thirty characters opening, then two.",
    "Kick off here now. 45+3 mins: a late goal! 90 min +2 it ends level. Two words.", "In 5 minutes it was over. Or 12 min later",
    "The same thirty characters opening, then one.", "first line \n second  line ", "", "ends at ten ", "plain text", None,
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put("documents", [(k + 2, t, ["en", "de"][k % 2], f"s{k}", len(t or "")) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    put("conversations", [(k, 1, "user", t) for k, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string")
    put("pages", [(k, "u", t) for k, t in enumerate(TEXTS)], "page_id long, url string, html string")
    return d


def by_id(spark, tables, name):
    assert name not in ORACLES
    return {r[0]: r for r in QUERIES[name](spark, tables).collect()}


def squeeze(t):
    return re.sub(r"\s+", " ", t).strip()


def test_representation_text_whole(spark, tables):
    want = {}
    for k, t in enumerate(TEXTS):
        lang = ["en", "de"][k % 2]
        parts = [("Title", squeeze((t or "").split("\n")[0])), ("Categories", "" if lang == "en" else lang), ("Keywords", f"s{k}; {lang}"), ("Body", squeeze(t or ""))]
        want[k + 2] = " | ".join(f"{n}: {v}" for n, v in parts if v)
    assert {k: r["repr"] for k, r in by_id(spark, tables, "representation_text_whole").items()} == want


def test_response_changed_whole(spark, tables):
    fold = lambda t: squeeze(re.sub(r"^\s*highlight\s*:\s*", "", t.strip(), flags=re.I)).casefold()
    want = {k: fold(t or "") != fold("" if t is None else f"Highlight: {t.upper()} ") for k, t in enumerate(TEXTS)}
    assert {k: r["changed"] for k, r in by_id(spark, tables, "response_changed_whole").items()} == want
    assert want[1] is False and want[4] is True


def test_metric_summary_and_html_whole(spark, tables):
    got = by_id(spark, tables, "metric_summary_whole")
    for k, t in enumerate(TEXTS):
        x = f"[SUMMARY]<|x|> Summary : {t or ''}\u3000[/SUMMARY]".replace("[SUMMARY]", " ").replace("[/SUMMARY]", " ")
        x = re.sub(r"^\s*(summary|summaries|摘要)\s*[:：]\s*", "", re.sub(r"<\|.*?\|>", " ", x), flags=re.I)
        assert got[k]["summary"] == squeeze(x) and got[k]["legacy"] == bool(re.search(r"\[(SUMMARY|TASK=SUMMARY)\]", t or ""))
    got = by_id(spark, tables, "html_escape_whole")
    assert {k: r["safe"] for k, r in got.items()} == {k: None if t is None else html.escape(t, quote=True) for k, t in enumerate(TEXTS)}


def test_chunk_ingest_whole(spark, tables):
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [(k + 2, key(t)) for k, t in enumerate(TEXTS) if t is not None]
    stored = {h for k, h in rows if k % 5 == 1}
    want = {h: min(k for k, g in rows if g == h) for _, h in rows if h not in stored}
    got = QUERIES["chunk_ingest_whole"](spark, tables).collect()
    assert len(got) == len(want) and {r["k"]: r["doc_id"] for r in got} == want


def test_hybrid_search_whole(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, m = list(e.vec_id), np.stack(list(e.embedding)).astype(float)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["doc_id"] in set(ids)}
    terms = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in docs.items()}
    tf, avg = {k: Counter(w) for k, w in terms.items()}, sum(map(len, terms.values())) / len(terms)
    df = Counter(w for c in tf.values() for w in c)
    scale = lambda x: {k: (v - min(x.values())) / (max(x.values()) - min(x.values())) if max(x.values()) > min(x.values()) else 1.0 for k, v in x.items()}
    want = {}
    for n, q in enumerate(ids):
        if q % 50:
            continue
        v = scale({d: round(float(x), 9) for d, x in zip(ids, m @ m[n], strict=True) if d != q})
        sentences = [x.strip() for x in re.split(r"(?<=[.!?])\s+", re.sub("(?i)^highlight:", "", docs.get(q, "").strip()).strip()) if x.strip()]
        words = set(re.findall("[a-z0-9]+", sentences[0].lower())) if sentences else set()
        hit = {d: [w for w in words if w in c] for d, c in tf.items() if d != q and words & set(c)}
        idf = {w: math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) for w in words}
        k = scale({d: sum(idf[w] * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * len(terms[d]) / avg)) for w in ws) for d, ws in hit.items()}) if hit else {}
        s = {d: 0.7 * x + 0.3 * k.get(d, 0) for d, x in v.items()}
        want[q] = sorted(s, key=lambda d: (-round(s[d], 9), d))[:8], s
    got = {}
    for r in QUERIES["hybrid_search_whole"](spark, sf_dir).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["doc"])
        assert r["score"] == pytest.approx(want[r["q"]][1][r["doc"]], abs=2e-6)
    assert got == {q: w for q, (w, _) in want.items()}
    rec = {r["q"]: r["ids"] for r in QUERIES["recommendation_records_whole"](spark, sf_dir).collect()}
    assert rec == {q: ",".join(map(str, w[:5])) for q, (w, _) in want.items()}
    packets = {r["q"]: r["packet"] for r in QUERIES["evidence_packets_whole"](spark, sf_dir).collect()}
    assert packets and all(p.startswith("0:" + ",".join(map(str, got[q][:2]))) for q, p in packets.items())
    best = {r["q"]: r["n"] for r in QUERIES["confident_topics_whole"](spark, sf_dir).collect()}
    assert best == {q: n for q, (w, s) in want.items() if (n := sum(s[d] >= 0.52 for d in w))}


def sentences(t):
    """A break before minute markers, then at sentence ends; three words at least."""
    t = re.sub(r"\s+(?=(?:\d{1,3}(?:\+\d+)?\s*mins?:|\d{1,3}\s*min(?:\s*\+\d+)?))", "\0", squeeze(t or ""), flags=re.I)
    return [x.strip() for b in t.split("\0") for x in re.split(r"(?<=[.!?])\s+", b) if len(x.split()) >= 3]


def test_sentences_whole(spark, tables):
    want = {k + 2: sentences(t) for k, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n"] for r in QUERIES["article_sentences"](spark, tables).collect()}
    assert counts == {k: len(v) for k, v in want.items()}
    got = {r["chunk_id"]: r["chunk_text"] for r in QUERIES["sentence_chunks"](spark, tables).collect()}
    assert got == {f"{k}::sent::{i}": x for k, v in want.items() for i, x in enumerate(v)}
    assert any(x.startswith("45+3 mins:") for x in got.values())
