"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

The classifier is trained on the driver from a small labelled URL table (``labelled_table``; a
caller passes another) by full-batch gradient descent; its weights, one per hash bucket, go into the
query as a constant array, so scoring is one expression inside the scan and nothing is shuffled.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, and is
allowed (it has no n-gram to judge by).  Repeated rows are judged alike, each on its own; an empty
table gives an empty result; columns beyond page_id and url are ignored.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ascii_lower

#: (verdict, host, path prefix); the longest that fits wins.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Stems of unwanted and of ordinary hosts, from which ``labelled_table`` makes its urls.
UNWANTED = """casino poker roulette blackjack slots jackpot betting bookmaker lottery gamble pills pharmacy viagra
tablets slimming replica adult xxx porn escort spam clickbait popunder adserver tracker banner affiliate loan payday
casinos spins wager drugs pharma betonline freebet cheapmeds freespin winbig spammy linkfarm""".split()
ORDINARY = """library university museum weather history science garden recipe school archive travel music health theatre
council station market bridge forest island harbour village church castle review journal gazette times herald tribune
learn code research energy climate planet ocean mountain river kitchen family sport football cinema photo design open
data city north south east west green water house home world people story paper letter night morning winter summer""".split()


@lru_cache(maxsize=2)
def labelled_table(rows: int = 480, seed: int = 29) -> tuple[tuple[str, int], ...]:
    """Urls without scheme and whether they are unwanted (1): stems, alone or paired, and invented
    words under ordinary and unwanted hosts alike, so that neither paths nor pairing tell."""
    rng = random.Random(seed)
    syllables = "an er on es en de la re ti st ou le ion ing the nd at or ar al in".split()
    invent = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    out = []
    for k in range(rows):
        bad = k % 2
        stems = [rng.choice(UNWANTED if bad else rng.choice((ORDINARY, [invent()]))) for _ in range(rng.randint(1, 2))]
        if bad and len(stems) == 2 and rng.random() < 0.5:
            stems[rng.randint(0, 1)] = rng.choice((rng.choice(ORDINARY), invent()))
        host = rng.choice(("", "", "www.", "m.", "blog.")) + rng.choice(("", "-")).join(stems)
        host += "." + rng.choice(("example.com", "example.org", "com", "org", "info"))
        path = "/" + rng.choice(("", f"{rng.choice(('en', 'de', 'fr', 'es'))}/{rng.randint(1, 999)}", f"{invent()}.html", f"{rng.choice(ORDINARY)}/{invent()}"))
        out.append((host + path, bad))
    return tuple(out)


GRAMS = (3, 4, 5)
BUCKETS = 4096


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, rhost, rpath in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        found = F.struct(F.lit(rhost + rpath).alias("rule"), F.lit(verdict).alias("verdict"))
        out = (F if out is None else out).when(fits, found)
    return out


def grams_of(s: str) -> list[int]:
    """The hash buckets of a string's character n-grams (the Python side of ``score``)."""
    return [zlib.crc32(s[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(s) - n + 1)]


@lru_cache(maxsize=4)
def train(labelled: tuple[tuple[str, int], ...] | None = None, epochs: int = 400, rate: float = 8.0, decay: float = 1e-4) -> tuple[tuple[float, ...], float]:
    """Weights by bucket and the bias, by full-batch gradient descent on the logistic loss.  Each
    url's n-gram counts are scaled by the root of their number."""
    rows = labelled_table() if labelled is None else labelled
    x, y = np.zeros((len(rows), BUCKETS)), np.array([float(v) for _, v in rows])
    for k, (u, _) in enumerate(rows):
        g = grams_of(u)
        np.add.at(x[k], g, 1.0 / math.sqrt(max(1, len(g))))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        err = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -30.0, 30.0))) - y
        w -= rate * (x.T @ err / len(rows) + decay * w)
        b -= rate * err.mean()
    return tuple(round(float(v), 6) for v in w), round(float(b), 6)


def _adder(table: Column, subject: Column, n: int):
    def add(acc: Column, i: Column) -> Column:
        gram = F.encode(F.substr(subject, i, F.lit(n)), "UTF-8")
        return acc + F.get(table, F.pmod(F.crc32(gram), F.lit(BUCKETS)).cast("int"))

    return add


def score(subject: Column, model: tuple[tuple[float, ...], float]) -> Column:
    """Probability that a host and path are unwanted; 0 where there is no n-gram."""
    weights, bias = model
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # folded into a constant
    total, count = F.lit(0.0), F.lit(0)
    for n in GRAMS:
        many = F.greatest(F.length(subject) - n + 1, F.lit(0))
        places = F.when(many > 0, F.sequence(F.lit(1), F.greatest(many, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        total, count = total + F.aggregate(places, F.lit(0.0), _adder(table, subject, n)), count + many
    z = F.lit(bias) + total / F.sqrt(F.greatest(count, F.lit(1)))
    return F.when(count > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))


def judge(pages: DataFrame, rules=RULES, labelled=None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = parse(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).withColumn(
        "subject", F.concat("host", "path")
    )
    model = train(labelled)
    verdict = F.when(F.col("found").isNotNull(), F.col("found.verdict")).otherwise(
        F.when(score(F.col("subject"), model) >= threshold, "block").otherwise("allow")
    )
    return p.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def brute_force(url: str | None) -> tuple[str, str, str | None, str]:
    """The same in plain Python, for tests: (host, path, rule, verdict)."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        v, h, p = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, v
    weights, bias = train()
    g = grams_of(host + path)
    z = bias + sum(weights[k] for k in g) / math.sqrt(max(1, len(g)))
    return host, path, None, "block" if g and z >= 0 else "allow"
