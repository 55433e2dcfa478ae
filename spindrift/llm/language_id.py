"""Language ID by hierarchical discrimination.

A text becomes the counts of its hashed byte n-grams (whole text, lower-cased, any length).  A
linear support vector machine per family picks the family first (one against the rest); inside it
one-versus-one machines vote between its languages, ties going to the larger summed margin.

Training takes a bounded, seeded sample of labelled rows (``per_language``, a parameter): for each
language the rows are counted over the whole table and a threshold on the text's hash chosen to give
about that many; equal texts are learned from once a language.  Only rows whose crc32(doc_id as text) mod 4 is not 2 are learned from.  The model is a few
vectors of ``DIM`` floats, whatever the corpus; it is the only thing sent to the executors.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every row if
nothing could be learned.  A null lang is never learned from.  With one language learned, every
text with a letter gets it.  Repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textbytes as tb

#: Language families by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
DIM = 4096
ORDERS = (1, 2, 3, 4)


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only:{lang}")


def features(data: np.ndarray, off: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row per text: square roots of its hashed n-gram counts, scaled to unit length."""
    n, rows = len(data), len(off) - 1
    owner = np.repeat(np.arange(rows, dtype=np.int64) * dim, np.diff(off))
    out = np.zeros(rows * dim)
    h = np.zeros(n, np.uint32)
    for k in ORDERS:
        if n < k:
            break
        h = h[: n - k + 1] * np.uint32(0x9E3779B1) + data[k - 1 :].astype(np.uint32) + np.uint32(k)
        x = h ^ (h >> np.uint32(15))
        x = (x * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        same = owner[: n - k + 1] == owner[k - 1 :]
        at = owner[: n - k + 1] + x.astype(np.int64) % dim
        out += np.bincount(at[same], minlength=rows * dim)
    out = np.sqrt(out.reshape(rows, dim))
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1e-3, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss, l2) by averaged stochastic subgradient; y is +1 or -1.  Classes
    weigh the same however many rows they have."""
    rng = np.random.default_rng(seed)
    w, mean, b, b_mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for e in range(epochs):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 1.0 / (c * (t + 100))
            w *= 1 - rate * c
            if y[i] * (x[i] @ w + b) < 1:
                w += rate * weight[i] * y[i] * x[i]
                b += min(rate, 1.0) * 0.1 * weight[i] * y[i]
            if e >= epochs // 2:
                mean += w
                b_mean += b
    steps = len(y) * (epochs - epochs // 2)
    return (mean / steps).astype(np.float32), float(b_mean / steps)


@dataclass
class Model:
    """``heads``: (members, pairs, matrix, bias) by family; ``top``: one machine per family."""

    families: list[str]
    top: tuple[np.ndarray, np.ndarray]
    heads: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of features."""
        squash = lambda z: 1 / (1 + np.exp(-np.clip(2 * z, -30, 30)))
        m = x @ self.top[0] + self.top[1] if len(self.families) > 1 else np.ones((len(x), 1))
        pick = m.argmax(1)
        langs, scores = [""] * len(x), squash(m.max(1))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(pick == f)
            members, pairs, w, b = self.heads[name]
            if not pairs or not len(rows):
                for r in rows:
                    langs[r] = members[0]
                continue
            z = x[rows] @ w + b
            votes, margin = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for k, (i, j) in enumerate(pairs):
                votes[:, i] += z[:, k] >= 0
                votes[:, j] += z[:, k] < 0
                margin[:, i] += z[:, k]
                margin[:, j] -= z[:, k]
            best = (votes + squash(margin) / 2).argmax(1)
            for r, k in zip(rows, best, strict=True):
                langs[r] = members[k]
            scores[rows] *= squash(margin[np.arange(len(rows)), best] / (len(members) - 1))
        return langs, scores


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """Train every machine of the hierarchy."""
    if not langs:
        return None
    lang = np.array(langs)
    fam = np.array([family(v) for v in langs])
    families, heads = sorted(set(fam)), {}
    machines = [fit_svm(x, np.where(fam == f, 1.0, -1.0)) for f in families] if len(families) > 1 else []
    for f in families:
        members = sorted(set(lang[fam == f]))
        pairs = list(combinations(range(len(members)), 2))
        fits = []
        for i, j in pairs:
            rows = (lang == members[i]) | (lang == members[j])
            fits.append(fit_svm(x[rows], np.where(lang[rows] == members[i], 1.0, -1.0)))
        heads[f] = (members, pairs, *_stack(fits, x.shape[1]))
    return Model(families, _stack(machines, x.shape[1]), heads)


def _stack(machines, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if not machines:
        return np.zeros((dim, 0), np.float32), np.zeros(0, np.float32)
    return np.stack([w for w, _ in machines], 1), np.array([b for _, b in machines], np.float32)


def held_out() -> Column:
    """Whether a document is never learned from."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2


def _featurise(batches):
    for batch in batches:
        data, off = tb.arrow_bytes(batch.column("t"))
        vectors = [
            v.astype(np.float16).tobytes()
            for i, j in tb.slices(off, 1 << 18)
            for v in features(data[off[i] : off[j]], off[i : j + 1] - off[i])
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("u"), pa.array(vectors, pa.binary())], names=["lang", "u", "v"]
        )


def learn(docs: DataFrame, per_language: int = 400, seed: int = 23) -> Model | None:
    """Fit the hierarchy on about ``per_language`` rows of each language."""
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    counts = {r["lang"]: r["count"] for r in may.groupBy("lang").count().collect()}
    if not counts:
        return None
    u = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))
    limit = F.lit(0)
    for v, n in counts.items():
        limit = F.when(F.col("lang") == v, F.lit(min(1 << 30, int((1 << 30) * per_language / n)))).otherwise(limit)
    rows = (
        may.withColumn("u", u)
        .where(F.col("u") < limit)
        .where(F.col("text").rlike(r"\p{L}"))
        .select("lang", "u", F.lower("text").alias("t"))
        .mapInArrow(lambda b: _featurise(x.select(["t", "lang", "u"]) for x in b), "lang string, u long, v binary")
        .dropDuplicates(["lang", "u"])
        .orderBy("u", "lang")
        .limit(2 * per_language * len(counts))  # by hash, so a rerun takes the same rows
        .collect()
    )
    rows = sorted((r["lang"], r["u"], bytes(r["v"])) for r in rows)  # the order of arrival doesn't matter
    if not rows:
        return None
    return fit(np.stack([np.frombuffer(v, np.float16) for *_, v in rows]).astype(np.float32), [v for v, *_ in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    d = docs.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.coalesce(F.lower("text"), F.lit("")).alias("t"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("ok"),
    )

    def run(batches):
        for batch in batches:
            data, off = tb.arrow_bytes(batch.column("t"))
            ok = np.array(batch.column("ok").to_pylist(), bool)
            langs: list[str] = []
            scores: list[float] = []
            for i, j in tb.slices(off, 1 << 19):
                if model is None:
                    langs, scores = langs + ["und"] * (j - i), scores + [0.0] * (j - i)
                    continue
                for k in range(i, j, 128):
                    m = min(j, k + 128)
                    a, s = model.predict(features(data[off[k] : off[m]], off[k : m + 1] - off[k]))
                    langs += a
                    scores += s.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([v if k else "und" for v, k in zip(langs, ok, strict=True)], pa.string()),
                    pa.array([v if k else 0.0 for v, k in zip(scores, ok, strict=True)], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    """Learn from the table's labelled rows, then identify every document."""
    docs = docs.select("doc_id", "text", "lang")
    return identify(docs, learn(docs))
