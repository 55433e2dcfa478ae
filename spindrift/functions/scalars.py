"""Hashes, weights, schedules, arrays and vectors as Catalyst expressions."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no spaces; nulls are written, not dropped."""
    parts = []
    for k in sorted(fields):
        text = fields[k].cast("string")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        parts.append(F.concat(F.lit(f'"{k}":'), F.coalesce(quoted, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def vector_hash(text: Column, model: str, dims: int) -> Column:
    """What a vector depends on: model, dimensions and text."""
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(str(dims)), text), 256)


def fallback_id(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.md5(F.concat_ws("|||", *parts)), 1, length)


def ids_digest(ids: Column) -> Column:
    """SHA-1 over ordered ids, one per line."""
    return F.sha1(F.concat(F.array_join(F.transform(ids, lambda x: x.cast("string")), "\n"), F.lit("\n")))


def object_uuid(name: Column) -> Column:
    """Version 5 UUID in the URL namespace; Spark has none built in."""

    @F.pandas_udf("string")
    def uuids(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))

    return uuids(name)


def stable_unit(key: Column) -> Column:
    """BLAKE2b of a key as a number in [0, 1); Spark has no BLAKE2b, so Arrow batches of hashlib."""

    @F.pandas_udf("double")
    def unit(s: pd.Series) -> pd.Series:
        return s.map(lambda x: int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "big") / 2.0**64)

    return unit(key)


def sample_size_sqrt(size: Column, tau: float, cap: int) -> Column:
    """1 + floor(sqrt(size) / tau), at most cap and size."""
    return F.least(F.lit(1) + F.floor(F.sqrt(size) / F.lit(float(tau))), F.lit(cap), size).cast("long")


def sample_size_log(size: Column, base: float, cap: int) -> Column:
    """1 + floor(log(size) to a base), at most cap and size."""
    return F.least(F.lit(1) + F.floor(F.ln(size) / F.ln(F.lit(float(base)))), F.lit(cap), size).cast("long")


def rank_weight(
    rank: Column, total: Column, base: float = 1.2, alpha: float = 0.3, power: float = 1.0, only: float = 1.3
) -> Column:
    """base * (1 + alpha * ((rank - 1) / (total - 1)) ** power); a label alone weighs ``only``."""
    frac = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rank - 1) / F.greatest(total - 1, F.lit(1))))
    return F.when(total == 1, F.lit(only)).otherwise(F.lit(base) * (1 + F.lit(alpha) * F.pow(frac, F.lit(power))))


def token_weight(budget: Column, count: Column, mode: str = "affine", alpha: float = 0.5, gamma: float = 0.5) -> Column:
    """A group's budget per token: divided by the count (strict), 1 + alpha * (count - 1) (affine)
    or count ** gamma (power)."""
    divisors = {"strict": count, "affine": 1 + F.lit(alpha) * (count - 1), "power": F.pow(count, F.lit(gamma))}
    return budget / divisors[mode]


def idf_weight(n_docs: Column, df: Column, scale: float, cap: float) -> Column:
    """max(1, min(cap, scale * ln((N + 1) / (df + 1))))."""
    return F.greatest(F.lit(1.0), F.least(F.lit(float(cap)), F.lit(float(scale)) * F.ln((n_docs + 1) / (df + 1))))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def binned_schedule(progress: Column, first: float, last: float, begin: float, anchor: float, bin_width: float) -> Column:
    """A line from ``first`` to ``last`` between two points of progress, in bins; flat outside."""
    bins = max(1, math.ceil(1.0 / bin_width))
    if bins == 1 or abs(anchor - begin) <= 1e-12:
        return F.when(progress <= begin, F.lit(first)).otherwise(F.lit(last)) if bins == 1 else F.lit(last)
    place = F.least(F.floor((progress - begin) / F.lit(anchor - begin) / F.lit(bin_width)), F.lit(bins - 1))
    line = F.lit(first) + F.lit(last - first) * place / F.lit(bins - 1)
    return F.when(progress <= begin, F.lit(first)).when(progress >= anchor, F.lit(last)).otherwise(line)


def ends_with(a: Column, suffix: Sequence[int]) -> Column:
    """Whether an array ends with a sequence."""
    n = len(suffix)
    tail = F.when(F.size(a) >= n, F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n)))
    return F.coalesce(tail == F.array(*map(F.lit, suffix)), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.  An expression that a lambda names is computed again
    for every element, as projections are merged into one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def answer_labels(prompt: Column, answer: Column, terminals: Sequence[Sequence[int]], mode: str) -> Column:
    """Labels: -100 for the prompt; the answer's terminal tail kept as mode (all, final_only, none)."""
    ids = F.array(*(F.lit(t) for seq in terminals for t in seq))
    size = F.size(answer)
    tail = F.aggregate(
        F.reverse(answer), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda acc, x: F.struct(
            F.when(acc["go"] & F.array_contains(ids, x), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["go"] & F.array_contains(ids, x)).alias("go"),
        ),
        lambda acc: acc["n"],
    )
    masked = lambda end: let(size - tail, lambda n: F.transform(answer, lambda x, i: F.when((i >= n) & (i < end), F.lit(-100)).otherwise(x)))
    kept = {"all": lambda: answer, "none": lambda: masked(size)}.get(mode, lambda: masked(size - 1))()
    return F.concat(F.transform(prompt, lambda _: F.lit(-100)), kept)


def kept_by_mask(values: Column, mask: Column) -> Column:
    """The values whose mask isn't -100."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] != -100), lambda x: x["v"])


def padded(a: Column, length: Column, pad) -> Column:
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(length - F.size(a), F.lit(0))))


def item_scores(gold: Column, predicted: Column) -> Column:
    """Struct (precision, recall, f1, exact) of two item sets; both empty counts as a match."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    hits = F.size(F.array_intersect(g, p))
    none = (F.size(g) == 0) & (F.size(p) == 0)
    prec = F.when(none, 1.0).when(F.size(p) > 0, hits / F.size(p)).otherwise(0.0)
    rec = F.when(none, 1.0).when(F.size(g) > 0, hits / F.size(g)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    exact = (hits == F.size(g)) & (hits == F.size(p))
    return F.struct(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), exact.alias("exact"))
