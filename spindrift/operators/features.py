"""Trainer rows: span weights, contracts, manifests and prompts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.scalars import let


def token_roles(tokens: Column, spans: Column) -> Column:
    """For each token (struct start, end) the index of the span (struct start, end) that it
    overlaps most, the first of equals; -1 for none."""
    overlap = lambda t, s: F.greatest(F.lit(0), F.least(t["end"], s["end"]) - F.greatest(t["start"], s["start"]))
    pick = lambda t: F.array_max(F.transform(spans, lambda s, i: F.struct(overlap(t, s).alias("o"), (-i).alias("i"))))
    return F.transform(tokens, lambda t: let(pick(t), lambda p: F.when(F.coalesce(p["o"], F.lit(0)) > 0, -p["i"]).otherwise(F.lit(-1))))


def role_weights(roles: Column, budgets: Column, gamma: float) -> Column:
    """Each token's share of its span's budget: budget / count ** gamma; outside spans 0."""
    count = lambda r: F.size(F.filter(roles, lambda x: x == r))
    return F.transform(roles, lambda r: F.when(r < 0, F.lit(0.0)).otherwise(F.get(budgets, r) / F.pow(count(r), F.lit(gamma))))


#: The trainer row contract: name and what breaks it.
CONTRACT = (
    ("empty", "size(input_ids) = 0"),
    ("unequal_lengths", "size(input_ids) <> size(attention_mask) OR size(input_ids) <> size(labels) OR size(input_ids) <> size(loss_weights)"),
    ("token_out_of_range", "exists(input_ids, x -> x < 0 OR x >= {vocab})"),
    ("bad_mask", "exists(attention_mask, x -> x NOT IN (0, 1))"),
    ("bad_label", "exists(labels, x -> x <> -100 AND (x < 0 OR x >= {vocab}))"),
    ("bad_weight", "exists(loss_weights, x -> x IS NULL OR isnan(x) OR x < 0 OR x = double('inf'))"),
    ("no_target", "NOT exists(labels, x -> x <> -100)"),
    ("too_long", "size(input_ids) > {limit}"),
)


def violations(rows: DataFrame, vocab: int, limit: int) -> DataFrame:
    """``rows`` with one boolean per rule of the contract; a null array breaks its rule."""
    return rows.select("*", *(F.coalesce(F.expr(c.format(vocab=vocab, limit=limit)), F.lit(True)).alias(n) for n, c in CONTRACT))


def violation_counts(rows: DataFrame, vocab: int, limit: int) -> DataFrame:
    """(rule, n) over all rows in one pass."""
    v = violations(rows, vocab, limit).agg(*(F.count_if(F.col(n)).alias(n) for n, _ in CONTRACT))
    return v.unpivot([], [n for n, _ in CONTRACT], "rule", "n")


def first_bad_row(rows: DataFrame, key: str, vocab: int, limit: int) -> DataFrame:
    """The least key of a row that breaks any rule."""
    bad = " OR ".join(n for n, _ in CONTRACT)
    return violations(rows, vocab, limit).where(bad).agg(F.min(key).alias(key))


def config_hash(config: dict) -> str:
    """SHA-256 of a configuration as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def manifest(splits: DataFrame, split: str, config: dict) -> DataFrame:
    """One row per split: rows, and the configuration's hash."""
    return splits.groupBy(split).agg(F.count("*").alias("rows")).withColumn("config_hash", F.lit(config_hash(config)))


def manifest_mismatches(found: DataFrame, expected: DataFrame, split: str) -> DataFrame:
    """Splits whose row counts differ between two manifests, or that only one has."""
    e = expected.select(split, F.col("rows").alias("expected"))
    f = found.select(split, F.col("rows").alias("found"))
    return f.join(e, split, "full_outer").where(~F.col("found").eqNullSafe(F.col("expected")))


def prompt_rows(title: Column, body: Column, extra: Column) -> Column:
    """One prompt row, and a second (title only) where ``extra`` holds."""
    one = F.struct(F.lit("title_body").alias("kind"), F.concat(F.lit("Title: "), title, F.lit("\nBody: "), body).alias("prompt"))
    two = F.struct(F.lit("title_only").alias("kind"), F.concat(F.lit("Title: "), title).alias("prompt"))
    return F.array_compact(F.array(one, F.when(extra, two)))


def recover_prompt(input_ids: Column, labels: Column) -> Column:
    """Struct (prompt, reference): ids before the first label that counts, and the labels that do."""
    first = F.array_position(F.transform(labels, lambda x: x != -100), True)
    n = F.when(first > 0, first - 1).otherwise(F.size(labels)).cast("int")
    return F.struct(F.slice(input_ids, F.lit(1), n).alias("prompt"), F.filter(labels, lambda x: x != -100).alias("reference"))


def weighted_loss(rows: DataFrame, loss: str, mask: str, weight: str, sample: str, per_sample: bool) -> DataFrame:
    """Token mean, or the mean over samples with positive weight, of weighted losses."""
    m = rows.where(F.col(mask))
    mean = F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0) if not per_sample else F.lit(1e-12))
    if not per_sample:
        return m.agg(mean.alias("loss"))
    each = m.groupBy(sample).agg(mean.alias("x"), F.sum(weight).alias("w")).where("w > 0")
    return each.agg(F.avg("x").alias("loss"))


def trainer_rows(df: DataFrame, id_col: str, prompt: str, answer: str, path: str, limit: int, prompt_weight: float = 0.0) -> DataFrame:
    """Token rows that meet the contract: prompt then answer, labels on the answer only, weights
    ``prompt_weight`` and 1; rows without an answer or beyond ``limit`` tokens are left out."""
    from spindrift.functions import tokens

    d = df.select(id_col, tokens.token_ids(F.col(prompt), path).alias("p"), tokens.token_ids(F.col(answer), path).alias("a"))
    d = d.where((F.size("a") > 0) & (F.size("p") + F.size("a") <= limit))
    fill = lambda c, v: F.transform(c, lambda _: F.lit(v))
    ids = F.concat("p", "a")
    return d.select(
        id_col, ids.alias("input_ids"), fill(ids, 1).alias("attention_mask"), F.concat(fill("p", -100), "a").alias("labels"),
        F.concat(fill("p", float(prompt_weight)), fill("a", 1.0)).alias("loss_weights"),
    )


def inconsistent_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows whose prompt and reference, recovered from the labels, don't make up their tokens."""
    r = recover_prompt(F.col("input_ids"), F.col("labels"))
    return rows.where(F.concat(r["prompt"], r["reference"]) != F.col("input_ids")).select(id_col)
