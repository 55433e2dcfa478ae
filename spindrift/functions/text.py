"""Text functions as Catalyst expressions: cleaning, slicing, splitting, parsing and checks.

Patterns and word lists marked as fixed values must be what they are for right results.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as text tools see it: Java's \\s alone misses the no-break and wide spaces.
WHITE = r"(?U:[\s\x1c-\x1f])"
# Promotional prefixes of highlights.
PROMO_PREFIX = r"(?i)^(?:\s*(?:VIDEO|WATCH|NEW\s*:|NEW:|NEW\s*[-–—])\s*)+"
# Literal tokens that a target text must not start with, what may follow them, and
# spacing repairs in order.
TARGET_TOKENS = (
    "Larry King Live", "VIDEO", "Video", "WATCH", "Watch", "tonight", "Tonight",
    "NEW:", "NEW :", "NEW -", "NEW –", "NEW —", "NEW --",
)
AFTER_TOKEN = " \t:：-–—•|,."
SPACING = ((" . ", ". "), (" .", "."), (" ,", ","), (" ;", ";"), (" :", ":"), (" )", ")"), ("( ", "("))
# Markers of a tag format that is no longer used.
LEGACY_MARKERS = (
    "[TASK=SUMMARY]", "[TASK=HIGHLIGHT]", "[BODY]", "[/BODY]", "[SUMMARY]", "[/SUMMARY]", "[HIGHLIGHT]", "[/HIGHLIGHT]",
)
# What ends a sentence, what separates items, and word candidates.
SENTENCE_END = r"(?<=[.!?])\s+"
ITEM_SEPARATOR = r"[,;\n]+"
KEYWORD_SEPARATOR = r"[,;|]\s*"
WIDE_SEPARATOR = "[,，;；\n\t]+"
WORD_CANDIDATE = r"[A-Za-z0-9]+(?:[&'./-][A-Za-z0-9]+)*"
MINUTE = r"\d{1,3}(?:\+\d+)?\s*mins?:|\d{1,3}\s*min(?:\s*\+\d+)?"


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included; null stays null."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def collapse(c: Column) -> Column:
    """White-space runs (Unicode's included) to one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def clean_highlights(c: Column) -> Column:
    """Non-empty lines joined, promotional prefixes stripped, whitespace collapsed."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return collapse(F.regexp_replace(F.array_join(lines, " "), PROMO_PREFIX, ""))


def words(c: Column) -> Column:
    """Whitespace-separated words; a null or blank text has none."""
    return F.filter(F.split(collapse(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def word_slice(c: Column, start: int, end: int) -> Column:
    """Words ``start`` to ``end``, 1-based and inclusive; an end of 0 or less is open."""
    w = words(c)
    begin = max(1, start)
    size = F.lit(max(0, end - begin + 1)) if end > 0 else F.greatest(F.size(w) - begin + 1, F.lit(0))
    return F.array_join(F.slice(w, F.lit(begin), size), " ")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ") if n > 0 else F.lit("")


def head_words(c: Column, ratio: float) -> Column:
    """The first fraction of the words, rounded up, at least one; none for a ratio of 0."""
    if ratio <= 0:
        return F.lit("")
    w = words(c)
    n = F.least(F.size(w), F.greatest(F.lit(1), F.ceil(F.size(w) * F.lit(ratio)).cast("int")))
    return F.array_join(F.slice(w, F.lit(1), n), " ")


def tail_words(c: Column, ratio: float) -> Column:
    """The last fraction of the words."""
    if ratio <= 0:
        return F.lit("")
    w = words(c)
    n = F.least(F.size(w), F.greatest(F.lit(1), F.ceil(F.size(w) * F.lit(ratio)).cast("int")))
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def first_fraction(c: Column, fraction: float) -> Column:
    """The first fraction of the characters, clamped to [0.01, 1] and rounded up."""
    f = min(1.0, max(0.01, fraction))
    return F.left(c, F.greatest(F.lit(1), F.ceil(F.length(c) * F.lit(f)).cast("int")))


def truncate_chars(c: Column, n: int) -> Column:
    return F.trim(F.left(c, F.lit(n)))


def representation(title: Column, categories: Column, keywords: Column, body: Column) -> Column:
    """``Title: … | Categories: a; b | Keywords: c; d | Body: …`` without its empty parts."""
    listed = lambda c: F.array_join(F.filter(F.transform(c, collapse), lambda x: x != ""), "; ")
    fields = (("Title", collapse(title)), ("Categories", listed(categories)), ("Keywords", listed(keywords)), ("Body", collapse(body)))
    parts = [F.when(v != "", F.concat(F.lit(f"{name}: "), v)) for name, v in fields]
    return F.array_join(F.array_compact(F.array(*parts)), " | ")


def normalize_label(c: Column) -> Column:
    """A numbered special label without its number."""
    return F.regexp_replace(c, r"^(.*special)\d+$", "$1")


def stringify_list(c: Column) -> Column:
    """A list as text: items trimmed, empty ones dropped, joined by comma and space."""
    return F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), ", ")


def is_true(c: Column, literals: Sequence[str] = ("1", "true", "t", "yes", "y")) -> Column:
    """Lenient boolean; the accepted literals are a parameter as callers differ."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*literals), F.lit(False))


def split_keywords(c: Column) -> Column:
    """Keywords, whitespace collapsed, first spelling of each (ignoring case) kept, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), KEYWORD_SEPARATOR), collapse), lambda x: x != "")
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def split_items(c: Column, pattern: str = ITEM_SEPARATOR) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip), lambda x: x != "")


def join_items(c: Column) -> Column:
    return F.array_join(c, ", ")


def normalize_combination(c: Column) -> Column:
    """Lower case, single spaces, ``, `` and ``; `` and ``|`` as the only forms of separators."""
    x = F.lower(collapse(c))
    for mark, form in ((",", ", "), (";", "; "), (r"\|", "|")):
        x = F.regexp_replace(x, rf"\s*{mark}\s*", form)
    return x




def strip_highlight_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?i)^{WHITE}*highlight{WHITE}*:{WHITE}*", ""))


def casefold(c: Column) -> Column:
    """Full case folding, which ``lower`` isn't: a sharp s equals ss."""

    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(str.casefold, na_action="ignore")

    return fold(c)


def comparable(c: Column) -> Column:
    """A response normalised for comparison."""
    return casefold(collapse(strip_highlight_prefix(F.coalesce(c, F.lit("")))))


def claim_sentences(c: Column) -> Column:
    """Sentences of a highlight, its label dropped, white space inside them kept."""
    t = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^highlight:", "")
    return F.filter(F.transform(F.split(strip(t), SENTENCE_END), strip), lambda x: x != "")


def article_sentences(c: Column, least_words: int = 3) -> Column:
    """Sentences of an article of ``least_words`` words or more, white space collapsed; a minute
    marker starts a new one."""
    blocks = F.split(F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), rf"(?i)\s+(?={MINUTE})", "\n"), "\n")
    pieces = F.flatten(F.transform(blocks, lambda x: F.split(F.trim(x), SENTENCE_END)))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: F.size(F.split(x, " ")) >= least_words)


def minute_marker(c: Column) -> Column:
    """The minute marker at the start of a sentence, or the empty string."""
    return F.regexp_extract(strip(c), rf"(?i)^({MINUTE})", 1)


def with_repetition(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with trigram and fourgram: some 3 words in a row stand thrice, some 4 twice.

    Words and sorted n-grams are columns of their own, so each is made once a row.
    """
    d = df.withColumn("_w", F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"(?U:\w+)"), F.lit(0)))
    d = d.withColumn("_g3", F.sort_array(ngrams(F.col("_w"), 3))).withColumn("_g4", F.sort_array(ngrams(F.col("_w"), 4)))

    def often(grams: str, times: int) -> Column:
        size = F.greatest(F.size(grams) - (times - 1), F.lit(0))
        equal = F.zip_with(F.slice(grams, F.lit(1), size), F.slice(grams, F.lit(times), size), lambda a, b: a == b)
        return F.exists(equal, lambda x: x)

    return d.withColumn("trigram", often("_g3", 3)).withColumn("fourgram", often("_g4", 2)).drop("_w", "_g3", "_g4")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of an array, by zipping its n shifted slices: the array isn't read
    again for each position."""
    size = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    shifted = F.arrays_zip(*(F.slice(tokens, F.lit(k + 1), size).alias(f"w{k}") for k in range(n)))
    return F.transform(shifted, lambda x: F.concat_ws(" ", *(x[f"w{k}"] for k in range(n))))


def payload(c: Column, field: str, following: str | None = None) -> Column:
    """What follows ``field:`` up to ``following:`` or the end."""
    tail = rf"(?:{following}\s*:|\z)" if following else r"\z"
    return F.trim(F.regexp_extract(c, rf"(?is){field}\s*:\s*(.*?)\s*{tail}", 1))







def cycling_join(items: Column, separators: Sequence[str]) -> Column:
    """Items joined with separators that take turns."""
    seps = F.array(*map(F.lit, separators))
    n = len(separators)
    return F.array_join(
        F.transform(items, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.get(seps, F.pmod(i - 1, F.lit(n))), x))), ""
    )


def normalize_keyword_field(c: Column) -> Column:
    """A keyword field that may be a JSON array, ``{a,b}`` array text or comma-separated text."""
    t = F.trim(F.coalesce(c, F.lit("")))
    as_json = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    inner = F.when(t.startswith("{") & t.endswith("}"), F.regexp_replace(t, r"^\{|\}$", "")).otherwise(t)
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), r'^"+|"+$', ""))
    return F.filter(F.coalesce(F.transform(as_json, strip), parts), lambda x: x != "")


def short_date(c: Column) -> Column:
    return F.date_format(c, "MMM d, yyyy")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def redact_parameter(c: Column, name: str) -> Column:
    return F.regexp_replace(c, rf"([?&]{name}=)[^&#]*", "$1REDACTED")


def word_candidates(c: Column) -> Column:
    """Distinct lower-cased word candidates in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(WORD_CANDIDATE), F.lit(0)), lambda x: F.lower(x)))


def canonical_item(c: Column) -> Column:
    """What makes two items the same: lower case, without quotes and brackets around them."""
    return F.lower(collapse(F.regexp_replace(collapse(c), r"^[\"'\[\](){}]+|[\"'\[\](){}]+$", "")))


def payload_items(c: Column) -> Column:
    """Items of a payload, wide separators included; the first spelling of each stays."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), WIDE_SEPARATOR), collapse), lambda x: canonical_item(x) != "")
    keys = F.transform(parts, canonical_item)
    return F.filter(parts, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)



def first_text(*columns: Column) -> Column:
    """The first value that isn't blank, trimmed of spaces; else the empty string."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))



def target_text(c: Column) -> Column:
    """A training target from highlights: lines joined, leading promotional tokens dropped however
    many there are, spacing before punctuation repaired.

    Dropping a token and what may follow it, again and again, is one anchored repetition: the
    tokens are alternatives in their order, so the longer forms of NEW can't be cut short.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    tokens = "|".join(re.escape(t) for t in TARGET_TOKENS)
    out = F.regexp_replace(F.array_join(lines, " "), rf"^(?:\s*(?:{tokens})[{re.escape(AFTER_TOKEN)}]*)+", "")
    for wrong, right in SPACING:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return collapse(out)


def has_legacy_tags(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("|".join(re.escape(m) for m in LEGACY_MARKERS))


def summary_for_metric(c: Column) -> Column:
    """A summary without tags, special tokens and its label, spaces (wide ones too) collapsed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[/?SUMMARY\]", " ")
    t = F.regexp_replace(t, r"<\|.*?\|>", " ")
    t = F.regexp_replace(t, r"(?i)^\s*(summary|summaries|摘要)\s*[:：]\s*", "")
    return collapse(F.replace(t, F.lit("\u3000"), F.lit(" ")))


def highlight_prompt(article: Column) -> Column:
    return F.concat(F.lit("Article:\n"), article)


def category_prompt(title: Column, body: Column, allowed: Sequence[str]) -> Column:
    """A prompt that lists what may be answered, then the title and the body."""
    return F.concat(F.lit("Allowed: " + ", ".join(allowed) + "\nTitle: "), title, F.lit("\nBody: "), body)


def prompt_guard(prompt: Column, start: str = "Article:\n") -> Column:
    """The prompt, or an error if it doesn't start as it must."""
    return F.when(prompt.startswith(start), prompt).otherwise(F.raise_error(F.concat(F.lit("bad prompt: "), F.left(prompt, F.lit(100)))))


def escape_html(c: Column) -> Column:
    """Text with the five characters that HTML reserves replaced."""
    out = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
