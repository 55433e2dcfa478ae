"""Trainer features of the two tasks: a summary of an article, and the labels of one.

An answer is made of pieces with a role and a weight; its tokens take the role and the weight of the
piece that they overlap most.  Everything but the tokenizer itself is a built-in expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import scalars as S
from spindrift.functions import text as T
from spindrift.functions import tokens
from spindrift.operators.features import token_roles

# How answers begin, and the weights of their parts.
SUMMARY_PREFIX, CATEGORY_PREFIX, KEYWORD_PREFIX = "highlight: ", "categories: ", "keywords: "
PREFIX_WEIGHT, SEPARATOR_WEIGHT, BODY_WEIGHT, TERMINAL_WEIGHT, MASKED_WEIGHT, LABEL_GAMMA = 0.2, 0.5, 1.0, 1.0, 0.0, 0.5

PIECES = "array<struct<role: string, text: string, weight: double, shared: boolean>>"


def piece(role: Column | str, text: Column | str, weight: Column | float, shared: bool = False) -> Column:
    """A part of an answer; the tokens of a shared one divide its weight by their count's root."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(role).alias("role"), lit(text).alias("text"), lit(weight).cast("double").alias("weight"), F.lit(shared).alias("shared"))


def summary_pieces(target: Column) -> Column:
    """Prefix and body of a summary; none if there is no summary."""
    body = F.trim(F.coalesce(target, F.lit("")))
    both = F.array(piece("highlight_prefix", SUMMARY_PREFIX, PREFIX_WEIGHT), piece("highlight_body", body, BODY_WEIGHT))
    return F.when(body != "", both).otherwise(F.array().cast(PIECES))


def _listed(items: Column, role: str, separator_role: str, separators: Sequence[str], ranked: bool) -> Column:
    """The items after a space each, separators in turn between them."""
    turn = F.array(*map(F.lit, separators))

    def one(x: Column, i: Column) -> Column:
        weight = S.rank_weight(i + 1, F.size(items)) if ranked else F.lit(BODY_WEIGHT)
        label = piece(F.concat(F.lit(f"{role}_"), (i + 1).cast("string")), F.concat(F.lit(" "), x), weight, ranked)
        between = piece(separator_role, F.get(turn, F.pmod(i - 1, F.lit(len(separators)))), SEPARATOR_WEIGHT)
        return F.when(i == 0, F.array(label)).otherwise(F.array(between, label))

    return F.flatten(F.transform(items, one))


def label_pieces(items: Column, prefix: str = CATEGORY_PREFIX, role: str = "cat_label") -> Column:
    """A prefix and labels, each with a budget by its rank that its tokens share; none for no labels."""
    head = F.array(piece("prefix", prefix.removesuffix(" "), PREFIX_WEIGHT))
    return F.when(F.size(items) > 0, F.concat(head, _listed(items, role, "separator", [","], True))).otherwise(F.array().cast(PIECES))


def both_pieces(categories: Column, keywords: Column, separators: Sequence[str] = (",",)) -> Column:
    """Categories, and keywords on a line of their own, every label token of weight 1; none unless
    both lists have something."""
    cats, words = (F.array(piece(r, p.removesuffix(" "), PREFIX_WEIGHT)) for r, p in (("cat_prefix", CATEGORY_PREFIX), ("kw_prefix", KEYWORD_PREFIX)))
    bridge = F.array(piece("bridge_newline", "\n", SEPARATOR_WEIGHT))
    whole = F.concat(
        cats, _listed(categories, "cat_label", "cat_separator", [","], False), bridge, words, _listed(keywords, "keyword", "kw_separator", separators, False)
    )
    return F.when((F.size(categories) > 0) & (F.size(keywords) > 0), whole).otherwise(F.array().cast(PIECES))


def _spans(pieces: Column) -> Column:
    """Where each piece stands in the answer."""
    kind = "array<struct<start: int, end: int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["text"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def features(rows: DataFrame, keep: Sequence[str], prompt: Column, pieces: Column, path: str, limit: int | None = None, terminal: Sequence[int] = (), mode: str = "final_only") -> DataFrame:
    """``keep`` and the trainer columns of every row with a prompt and an answer.

    The prompt's tokens have label -100 and weight 0; the answer's, then the ``terminal`` ids, follow.
    The terminal tail counts by ``mode`` (all, final_only, none).  Tokens beyond ``limit`` go and
    ``is_truncated`` says so; ``loss_ids``, ``loss_roles`` and ``loss_token_weights`` are those of the
    tokens whose label counts.
    """
    if mode not in ("all", "final_only", "none"):
        raise ValueError(f"mode must be all, final_only or none, got {mode}")
    d = rows.select(*keep, prompt.alias("prompt"), pieces.alias("_pieces"))
    d = d.withColumn("answer", F.array_join(F.transform("_pieces", lambda p: p["text"]), "")).where("trim(prompt) <> '' AND answer <> ''")
    d = d.withColumns({"prompt_ids": tokens.token_ids(F.col("prompt"), path), "_a": tokens.token_ids(F.col("answer"), path), "_at": tokens.token_segments(F.col("answer"), path)})
    pieces_col = F.col("_pieces")

    def weighed(of: Column, n: Column) -> Column:
        """Weights and roles of the tokens, from the piece of each and the tokens of each piece."""
        p = lambda k: F.get(pieces_col, k)
        each = lambda k: S.token_weight(p(k)["weight"], F.get(n, k), "power", gamma=LABEL_GAMMA)
        weight = F.transform(of, lambda k: F.when(p(k)["shared"], each(k)).otherwise(p(k)["weight"]))
        return F.struct(weight.alias("weights"), F.transform(of, lambda k: p(k)["role"]).alias("roles"))

    count = lambda of: F.transform(pieces_col, lambda _, k: F.size(F.filter(of, lambda x: x == k)))
    owner = lambda spans: F.transform(token_roles(F.col("_at"), spans), lambda k: F.greatest(k, F.lit(0)))
    held = S.let(_spans(pieces_col), lambda spans: S.let(owner(spans), lambda of: S.let(count(of), lambda n: weighed(of, n))))
    d = d.withColumn("_held", held)

    ends = F.array(*map(F.lit, terminal)).cast("array<int>")
    d = d.withColumn("answer_ids", F.concat("_a", ends))
    terminals = [list(terminal)] if terminal else []
    labels = S.answer_labels(F.col("prompt_ids"), F.col("answer_ids"), terminals, mode) if terminal else F.concat(F.transform("prompt_ids", lambda _: F.lit(-100)), "answer_ids")
    d = d.withColumn("_labels", labels.cast("array<int>"))
    tail = F.slice("_labels", F.size("prompt_ids") + F.size("_a") + 1, F.greatest(F.lit(0), F.lit(len(terminal))))
    blank = lambda v: F.transform("prompt_ids", lambda _: F.lit(v))
    active = lambda yes, no: F.transform(tail, lambda x: F.when(x != -100, F.lit(yes)).otherwise(F.lit(no)))
    cut = (lambda c: F.slice(c, 1, limit)) if limit is not None else (lambda c: c)
    d = d.withColumns({
        "input_ids": cut(F.concat("prompt_ids", "answer_ids")), "labels": cut(F.col("_labels")),
        "loss_weights": cut(F.concat(blank(0.0), F.col("_held.weights"), active(TERMINAL_WEIGHT, MASKED_WEIGHT))),
        "token_roles": cut(F.concat(blank("prompt"), F.col("_held.roles"), active("terminal_active", "terminal_masked"))),
    })
    zipped = F.arrays_zip("input_ids", "labels", "loss_weights", "token_roles")
    d = d.withColumn("_kept", F.filter(zipped, lambda z: z["labels"] != -100))
    return d.select(
        *keep, "prompt", "answer", "prompt_ids", "answer_ids", "input_ids", F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"), "labels", "loss_weights",
        "token_roles", F.col("_kept.input_ids").alias("loss_ids"), F.col("_kept.token_roles").alias("loss_roles"), F.col("_kept.loss_weights").alias("loss_token_weights"),
        (F.size("prompt_ids") + F.size("answer_ids") > F.size("input_ids")).alias("is_truncated"),
    )


def summary_features(
    rows: DataFrame, id_col: str, article: str, highlights: str, path: str, limit: int | None = None, article_tokens: int | None = None, terminal: Sequence[int] = (), mode: str = "final_only"
) -> DataFrame:
    """Articles, cut to ``article_tokens``, with their highlights as the answer."""
    text = F.trim(F.coalesce(F.col(article), F.lit("")))
    if article_tokens is not None:
        text = tokens.truncate_tokens(text, path, article_tokens)
    d = rows.where(F.trim(F.coalesce(F.col(article), F.lit(""))) != "")
    return features(d, [id_col], T.highlight_prompt(text), summary_pieces(T.target_text(F.col(highlights))), path, limit, terminal, mode)


def label_features(
    rows: DataFrame, id_col: str, title: str, body: str, task: str, path: str, allowed: Sequence[str], categories: str | None = None, keywords: str | None = None,
    limit: int | None = None, terminal: Sequence[int] = (), mode: str = "final_only",
) -> DataFrame:
    """Titles and bodies with their ``category``, ``keywords`` or ``both`` as the answer; a row
    without what its task asks for is left out."""
    pieces = {
        "category": lambda: label_pieces(F.col(categories)),
        "keywords": lambda: label_pieces(F.col(keywords), KEYWORD_PREFIX, "keyword"),
        "both": lambda: both_pieces(F.col(categories), F.col(keywords)),
    }
    if task not in pieces:
        raise ValueError(f"task must be one of {sorted(pieces)}, got {task}")
    one = lambda c: F.coalesce(F.col(c), F.lit(""))
    return features(rows, [id_col], T.category_prompt(one(title), one(body), allowed), pieces[task](), path, limit, terminal, mode)
