"""Document quality rules as a short-circuit cascade.

Each rule has a cost and a selectivity, both estimated on a bounded sample; the cascade asks the
rule with the most rejections per unit of cost first and stops at the first that rejects.  The
order changes how much work a rejected document costs, never the verdict.

Defined cases: a null, empty or blank text has no words, so every count is 0 and the document is
rejected (fewer than ``min_words`` words).  Repeated rows are judged alike, each on its own.  An
empty table gives an empty result.  Other columns pass through ``accepted`` whatever their names;
``judge`` replaces those that have the names of its own.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import SPACES, cut

@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the counts that its parameters name (keys of ``COUNTS``)."""

    name: str
    rejects: Callable[..., Column]

    @property
    def needs(self) -> list[str]:
        return list(inspect.signature(self.rejects).parameters)


#: The first two are the contract's base; the others follow published web-corpus filters.
BASE_RULES = (
    Rule("too_few_words", lambda n_words: n_words < 50),
    Rule("repeated_trigrams", lambda n_repeat_words, n_words: 100 * n_repeat_words > 50 * n_words),
)
METHOD_RULES = (
    Rule("symbol_ratio", lambda n_symbols, n_words: 10 * n_symbols > n_words),
    Rule("duplicate_lines", lambda n_lines, n_dup_lines: (n_lines >= 10) & (100 * n_dup_lines > 30 * n_lines)),
    Rule("mean_word_length", lambda word_chars, n_words: (word_chars < 3 * n_words) | (word_chars > 12 * n_words)),
    Rule("few_alphabetic_words", lambda n_alpha_words, n_words: 100 * n_alpha_words < 70 * n_words),
)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, and only where the result is asked for."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _words(t: Column) -> Column:
    """Without white space at its ends, a text splits into its words and nothing else."""
    return _let(F.btrim(t, F.lit(SPACES)), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"[\x20\x09-\x0D]+")))


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _repeats(w: Column) -> Column:
    """Words that stand in a word triple which occurs again: triples are hashed and, if any hash
    comes twice, sorted with their positions, so that equal ones are neighbours."""
    many = F.greatest(F.size(w) - 2, F.lit(0))
    starts = F.when(many > 0, F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        twice = F.zip_with(
            F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n),
            lambda x, y: F.when(x["h"] == y["h"], F.array(*(z["p"] + k for z in (x, y) for k in range(3)))),
        )
        return F.size(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))

    def unless_distinct(h: Column) -> Column:
        # only what comes twice is sorted; at most a few hashes are looked up one by one
        ordered = F.sort_array(h)
        n = F.greatest(F.size(h) - 1, F.lit(0))
        again = _let(ordered, lambda o: F.filter(F.zip_with(F.slice(o, F.lit(1), n), F.slice(o, F.lit(2), n), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()))

        def of_few(few: Column) -> Column:
            hit = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(few, x), i)), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

        def chosen(x: Column) -> Column:
            every = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("p"))))
            return F.when(F.size(x) <= 16, of_few(x)).otherwise(_let(every, count))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(again, chosen))

    return _let(hashes, unless_distinct)


#: Every count as an expression of the text and its words: code points in words, symbols, lines
#: with a word, lines equal to an earlier one, words in repeated triples, words with a letter.
COUNTS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")),
    "n_symbols": lambda t, w: F.regexp_count(t, F.lit("[#*$%&|<>]")),
    "n_lines": lambda t, w: F.size(_lines(t)),
    "n_dup_lines": lambda t, w: _let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda t, w: _repeats(w),
    "n_alpha_words": lambda t, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
}


def _rejects(rule: Rule, text: Column, words: Column, known: dict[str, Column]) -> Column:
    """Whether a rule rejects; a count that isn't known is made where the rule is asked."""
    made = [c for c in rule.needs if c not in known]
    if not made:
        return rule.rejects(*(known[c] for c in rule.needs))
    counts = F.struct(*(COUNTS[c](text, words).cast("long").alias(c) for c in made))
    return _let(counts, lambda s: rule.rejects(*(known.get(c, s[c] if c in made else None) for c in rule.needs)))


def order_rules(
    docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", rows: int = 400, fraction: float = 0.2, longest: int = 1 << 16
) -> list[Rule]:
    """The rules by rejections per cost, estimated on at most ``rows`` documents of at most
    ``longest`` bytes, sampled from the first partitions until there are enough of them: the rest
    isn't read.

    Costs are measured: each rule runs alone over the sample, which is written once; the time of a
    pass that only takes the texts apart into words is taken off, so that what is left is the rule's
    own.  Timing noise can change the order, never a verdict.  An empty sample keeps the given order.
    """
    spark = docs.sparkSession
    short = docs.select(F.col(text_col).alias("t")).where(F.octet_length("t") <= longest)
    taken = short.sample(False, fraction, 17).take(rows)
    if not taken:
        return list(rules)
    sample = cut(spark.createDataFrame(taken, "t string").repartition(1)).withColumn("w", _words(F.col("t")))
    text, words = F.col("t"), F.col("w")

    def timed(c: Column) -> tuple[float, int]:
        """Seconds of the second pass (the first plans and compiles), and how many documents ``c`` holds for."""
        asked = sample.agg(F.count_if(c))
        asked.collect()
        began = time.perf_counter()
        found = asked.collect()[0][0]
        return time.perf_counter() - began, found

    idle, _ = timed(F.size(words) < 0)
    rate = {}
    for r in rules:
        cost, found = timed(_rejects(r, text, words, {}))
        rate[r.name] = found / len(taken) / max(cost - idle, 1e-3)
    return sorted(rules, key=lambda r: -rate[r.name])


def cascade(rules: list[Rule], text: Column, words: Column, known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule that rejects, else null.  Later rules aren't asked, and a rule's
    counts are made where it is asked: a rejected document pays for no rule after the one that
    rejects it.  ``known`` holds counts that are there already."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(_rejects(r, text, words, known or {}), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all columns of ``docs``), _t (the text) and _w (its words)."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    return rows.withColumn("_w", _words(F.col("_t")))


RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``RETURNED``, base_failed and kept (both boolean), which replace
    columns of these names.  The base rules' counts are returned, so they are made for every
    document; the other rules are asked in order, and only of documents that pass the base."""
    rules = order_rules(docs, METHOD_RULES, text_col)
    text, words = F.col("_t"), F.col("_w")
    made = _rows(docs, text_col).withColumns({f"_{c}": COUNTS[c](text, words).cast("long") for c in RETURNED})
    known = {c: F.col(f"_{c}") for c in RETURNED}
    base = F.lit(False)
    for r in BASE_RULES:
        base = base | r.rejects(*(known[c] for c in r.needs))
    made = made.withColumn("_base", base)
    kept = F.when(F.col("_base"), F.lit(False)).otherwise(cascade(rules, text, words, known).isNull())
    own = [c for c in docs.columns if c not in (*RETURNED, "base_failed", "kept")]
    return made.select(*(F.col("row")[c].alias(c) for c in own), *(known[c].alias(c) for c in RETURNED), F.col("_base").alias("base_failed"), kept.alias("kept"))


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects; all rules are ordered, base ones too."""
    rules = order_rules(docs, BASE_RULES + METHOD_RULES, text_col)
    kept = cascade(rules, F.col("_t"), F.col("_w")).isNull()
    # a filter would be pushed below the words, which it would then make once per use
    return _rows(docs, text_col).select(F.explode(F.when(kept, F.array("row"))).alias("row")).select("row.*")


def quality_query(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    return judge(docs.select("doc_id", "text")).select("doc_id", *RETURNED, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, rid, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS ls FROM d
),
g AS (
  SELECT rid, i, list_extract(ws, i) || ' ' || list_extract(ws, i + 1) || ' ' || list_extract(ws, i + 2) AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g),
p AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_alpha_words
  FROM w LEFT JOIN p USING (rid)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 10 AND 100 * n_dup_lines > 30 * n_lines)
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 100 * n_alpha_words < 70 * n_words) AS kept
FROM b
"""
