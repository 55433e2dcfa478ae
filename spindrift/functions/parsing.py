"""What a model wrote, as columns: cleaned text, verdicts, routes, answers, categories, keywords.

Every parser returns a struct with the value, whether it may be trusted (``ok``) and a note that
says which of the known shapes the text had.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import normalize_label, split_items, strip

# Tokens that generation may leave in a text, and the prefixes of corrected answers.
SPECIAL_TOKENS = ("<|im_end|>", "<|endoftext|>", "<|end|>", "<|im_start|>")
ANSWER_PREFIX = "The correct answer is:"
CATEGORY_PREFIX = "The correct category is:"
KEYWORD_PREFIX = "The correct keywords are:"



def without_tokens(c: Column) -> Column:
    """A generated text without special tokens, stripped; null is empty."""
    pattern = "|".join(re.escape(t) for t in SPECIAL_TOKENS)
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), pattern, ""))


def without_thinking(c: Column) -> Column:
    """The same without closed think blocks and stray lower-case think tags."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", "")
    return without_tokens(F.regexp_replace(t, r"</?think>", ""))


def _result(value: Column, ok: Column, note: Column) -> Column:
    return F.struct(value.alias("value"), ok.alias("ok"), note.alias("note"))


def _unusable(raw: Column, clean: Column) -> Column:
    """Why there is nothing to parse, else null."""
    low = F.lower(raw)
    return (
        F.when(raw == "", "empty_output")
        .when(low.contains("<think>") & ~low.contains("</think>"), "unclosed_think_block_likely_truncated")
        .when(clean == "", "empty_after_removing_think")
    )


def first_round(c: Column) -> Column:
    """PASS or VERIFY: as whole words first, VERIFY before PASS, then inside words; else VERIFY."""
    t = F.regexp_replace(F.upper(without_thinking(c)), "[^A-Z]+", " ")
    return (
        F.when(t.rlike(r"\bVERIFY\b"), "VERIFY").when(t.rlike(r"\bPASS\b"), "PASS")
        .when(t.contains("VERIFY"), "VERIFY").when(t.contains("PASS"), "PASS").otherwise("VERIFY")
    )


def stage_one(c: Column) -> Column:
    """Struct (status, route, ok, note): a line that starts with PASS settles it; VERIFY needs a
    route line, and both routes are taken where it is missing."""
    t = without_thinking(c)
    passed, verify = t.rlike(r"(?i)(^|\n)\s*PASS\b"), t.rlike(r"(?i)(^|\n)\s*VERIFY\b")
    route = F.lower(F.regexp_extract(t, r"(?im)^\s*Route\s*:\s*(category|keywords|both)\b", 1))
    routed = verify & (route != "")
    note = (
        F.when(t == "", "empty_output").when(passed, "pass_short_circuit").when(~verify, "missing_pass_or_verify")
        .when(routed, "verify_with_route").otherwise("verify_missing_route_default_both")
    )
    return F.struct(
        F.when(passed, "PASS").otherwise("VERIFY").alias("status"),
        F.when(passed, "none").when(routed, route).otherwise("both").alias("route"),
        (passed | routed).alias("ok"),
        note.alias("note"),
    )


def final_answer(c: Column, prefix: str = ANSWER_PREFIX) -> Column:
    """The corrected answer after its prefix, at the start or later; without one, a text that
    starts as a highlight does."""
    raw, t = without_tokens(c), without_thinking(c)
    at = F.instr(F.lower(t), prefix.lower())
    rest = strip(F.substr(t, at + len(prefix)))
    starts = F.lower(t).startswith("highlight:")
    why = _unusable(raw, t)
    note = F.coalesce(
        why, F.when(at == 1, "prefix_at_start").when(at > 1, "prefix_found_later")
        .when(starts, "missing_prefix_but_starts_with_highlight").otherwise("missing_required_prefix")
    )
    usable = why.isNull()
    return _result(
        F.when(usable & (at > 0), rest).when(usable & starts, t).otherwise(""), usable & ((at > 0) | starts), note
    )


def prefixed_line(c: Column, prefix: str) -> Column:
    """What follows a prefix on its line: the first line that starts with it, else its first
    occurrence anywhere."""
    raw, t = without_tokens(c), without_thinking(c)
    lines = F.filter(F.split(t, r"\r\n|\n|\r"), lambda x: F.lower(strip(x)).startswith(prefix.lower()))
    first = F.get(lines, F.lit(0))
    on_line = strip(F.substr(strip(first), F.lit(len(prefix) + 1)))
    at = F.instr(F.lower(t), prefix.lower())
    later = strip(F.get(F.split(strip(F.substr(t, at + len(prefix))), r"\r\n|\n|\r"), F.lit(0)))
    why = _unusable(raw, t)
    value = F.when(why.isNotNull(), "").when(first.isNotNull(), on_line).when(at > 0, later).otherwise("")
    note = F.coalesce(why, F.when(first.isNotNull(), "prefix_line").when(at > 0, "prefix_found_later").otherwise("missing_required_prefix"))
    return _result(value, value != "", note)


def category_answer(c: Column, allowed: Sequence[str], prefix: str = CATEGORY_PREFIX) -> Column:
    """A category that must be allowed; quotes around it go; a bare allowed one will do."""
    quotes = lambda x: F.regexp_replace(strip(x), r"^[`'\"]+|[`'\"]+$", "")
    line, bare = prefixed_line(c, prefix), quotes(without_thinking(c))
    value = quotes(line["value"])
    given = line["ok"] & (value != "")
    known, known_bare = value.isin(*allowed), bare.isin(*allowed)
    return _result(
        F.when(given, value).when(known_bare, bare).otherwise(""),
        F.when(given, known).otherwise(known_bare),
        F.when(given & known, line["note"]).when(given, F.concat(line["note"], F.lit(";category_not_in_allowed_list")))
        .when(known_bare, "missing_prefix_but_exact_allowed_category").otherwise(line["note"]),
    )


def keyword_answer(c: Column, prefix: str = KEYWORD_PREFIX) -> Column:
    """Keywords after their prefix, or the only line of a text without it."""
    line, t = prefixed_line(c, prefix), without_thinking(c)
    listed = F.array_join(split_items(line["value"]), ", ")
    lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), strip), lambda x: x != "")
    bare = F.array_join(split_items(F.regexp_replace(F.get(lines, F.lit(0)), r"^`+|`+$", "")), ", ")
    given = line["ok"] & (listed != "")
    alone = _unusable(without_tokens(c), t).isNull() & (F.size(lines) == 1) & (F.coalesce(bare, F.lit("")) != "")
    return _result(
        F.when(given, listed).when(alone, bare).otherwise(""), given | alone,
        F.when(given, line["note"]).when(alone, "missing_prefix_but_bare_keywords").otherwise(line["note"]),
    )


def combined_answer(c: Column, allowed: Sequence[str]) -> Column:
    """Struct (category, keywords, ok, note) of an answer that holds both."""
    a, b = category_answer(c, allowed), keyword_answer(c)
    return F.struct(
        a["value"].alias("category"), b["value"].alias("keywords"), (a["ok"] & b["ok"]).alias("ok"),
        F.concat(F.lit("category="), a["note"], F.lit("; keywords="), b["note"]).alias("note"),
    )


def generated_fields(c: Column) -> Column:
    """Struct (categories, keywords) of a generated two-field text, as lists."""
    t = without_tokens(c)
    cats = F.regexp_extract(t, r"(?is)categories\s*:\s*(.*?)(?:\n\s*keywords\s*:|\n?\z)", 1)
    words = F.regexp_extract(t, r"(?is)keywords\s*:\s*(.*)\z", 1)
    return F.struct(split_items(cats).alias("categories"), split_items(words).alias("keywords"))


def labels_of_answer(c: Column) -> Column:
    """Labels of an answer: inside category tags, after ``categories:``, or the text itself; the
    first line, split at comma, bar and semicolon, numbered specials folded, once each."""
    t = strip(F.coalesce(c, F.lit("")))
    tagged = F.regexp_extract(t, r"(?is)\[CATEGORIES\](.*?)\[/CATEGORIES\]", 1)
    named = F.regexp_extract(t, r"(?is)categories\s*:\s*(.*)", 1)
    body = F.when(t.rlike(r"(?is)\[CATEGORIES\].*?\[/CATEGORIES\]"), tagged).when(t.rlike(r"(?i)categories\s*:"), named).otherwise(t)
    line = F.get(F.split(strip(body), r"\r\n|\n|\r"), F.lit(0))
    parts = F.transform(F.split(line, r"[,|;]"), lambda x: normalize_label(strip(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def both_output(c: Column) -> Column:
    """Format checks of a two-field output."""
    t = F.lower(without_tokens(c))
    a, b = F.instr(t, "categories:"), F.instr(t, "keywords:")
    order = (a > 0) & (b > 0) & (a < b)
    return F.struct(
        order.alias("format_ok"), (a > 0).alias("has_categories"), (b > 0).alias("has_keywords"), order.alias("order_ok"),
        t.contains(";").alias("has_semicolon"), F.coalesce(c, F.lit("")).rlike(r"<\|(im_end|endoftext|end)\|>").alias("has_special_token"),
    )


def highlight_output(c: Column) -> Column:
    """Format checks of a highlight output."""
    t = without_tokens(c)
    return F.struct(
        F.lower(t).startswith("highlight:").alias("format_ok"),
        F.coalesce(c, F.lit("")).rlike(r"<\|(im_end|endoftext|end)\|>").alias("has_special_token"),
        F.regexp_count(t, F.lit(r"\.")).alias("rough_sentence_count"),
    )


def evidence_text(claims: Column, top_n: int = 3, with_score: bool = False) -> Column:
    """Claims (structs of claim_idx, claim_sentence, evidence: array of rank, chunk_text, score)
    and their evidence as blocks of text."""

    def block(c: Column) -> Column:
        idx = c["claim_idx"].cast("string")

        def one(e: Column) -> Column:
            score = F.concat(F.lit(" | score="), e["score"].cast("string")) if with_score else F.lit("")
            return F.concat(F.lit("[Evidence "), idx, F.lit("."), e["rank"].cast("string"), score, F.lit("]\n"), F.coalesce(e["chunk_text"], F.lit("")))

        best = F.slice(c["evidence"], 1, top_n)
        none = F.array(F.lit("[Retrieved evidence]\nNo retrieved evidence."))
        head = F.array(F.concat(F.lit("[Claim "), idx, F.lit("]\n"), F.coalesce(c["claim_sentence"], F.lit(""))))
        return F.concat(head, F.when(F.size(best) > 0, F.transform(best, one)).otherwise(none))

    return strip(F.array_join(F.flatten(F.transform(claims, block)), "\n\n"))


def quality_status(changed: Sequence[Column], parsed: Sequence[Column]) -> Column:
    """PARSE_FAILED if any parse failed (null: not applicable), REVISED if anything changed, OK."""
    failed, any_changed = F.lit(False), F.lit(False)
    for p in parsed:
        failed = failed | F.coalesce(~p, F.lit(False))
    for c in changed:
        any_changed = any_changed | F.coalesce(c, F.lit(False))
    return F.when(failed, "PARSE_FAILED").when(any_changed, "REVISED").otherwise("OK")


# What error messages say.
QUOTA = r"429|RESOURCE_EXHAUSTED|Quota exceeded|(?i:rate limit)"
HARD_QUOTA = (
    r"GenerateRequestsPerDayPerProjectPerModel-FreeTier|free_tier_requests|quotaValue|Quota exceeded for metric|RESOURCE_EXHAUSTED"
)
TRANSIENT = (
    r"(?i)503|500|502|504|unavailable|temporarily|temporary|high demand|try again later|timeout|timed out|connection|server error|internal error"
)


def error_class(c: Column) -> Column:
    """hard_quota, quota, transient or other."""
    m = F.coalesce(c, F.lit(""))
    return F.when(m.rlike(HARD_QUOTA), "hard_quota").when(m.rlike(QUOTA), "quota").when(m.rlike(TRANSIENT), "transient").otherwise("other")
