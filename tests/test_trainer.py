"""Trainer features against a plain computation over the tokenizer's own output."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.operators import features as X
from spindrift.operators import trainer as R

PATH = "/opt/tokenizers/byte_bpe_50k.json"


def expected(prompt, pieces, terminal, mode, limit):
    """pieces: (role, text, weight, shared)."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    p, a = t.encode(prompt, add_special_tokens=False).ids, t.encode("".join(x[1] for x in pieces), add_special_tokens=False)
    owner = [k for k, x in enumerate(pieces) for _ in x[1]]
    of = []
    for s, e in a.offsets:
        held = [owner[c] for c in range(s, e)]
        of.append(max(sorted(set(held)), key=held.count) if held else 0)
    weights = [pieces[k][2] / (of.count(k) ** 0.5 if pieces[k][3] else 1) for k in of]
    labels = list(a.ids)
    end = {"all": list(terminal), "none": [-100] * len(terminal), "final_only": [-100] * (len(terminal) - 1) + list(terminal[-1:])}[mode]
    ids = p + a.ids + list(terminal)
    out = {
        "input_ids": ids, "labels": [-100] * len(p) + labels + end,
        "loss_weights": [0.0] * len(p) + weights + [0.0 if x == -100 else 1.0 for x in end],
        "token_roles": ["prompt"] * len(p) + [pieces[k][0] for k in of] + ["terminal_masked" if x == -100 else "terminal_active" for x in end],
    }
    cut = {k: v[:limit] for k, v in out.items()} if limit is not None else out
    keep = [x != -100 for x in cut["labels"]]
    for name, src in (("loss_ids", "input_ids"), ("loss_roles", "token_roles"), ("loss_token_weights", "loss_weights")):
        cut[name] = [x for x, k in zip(cut[src], keep, strict=True) if k]
    return cut | {"is_truncated": limit is not None and len(ids) > limit, "attention_mask": [1] * len(cut["input_ids"])}


def same(row, want):
    for name, value in want.items():
        got = row[name]
        assert got == (pytest.approx(value) if "weight" in name else value), name


@pytest.mark.parametrize("mode", ["all", "final_only", "none"])
@pytest.mark.parametrize("limit", [None, 12])
def test_summaries(spark, mode, limit):
    texts = ["The quick brown fox, twice.", "Café naïve 😀 über", "x"]
    d = spark.createDataFrame([(i, f" Article {i} on things ", t) for i, t in enumerate(texts)] + [(7, None, "a"), (8, "text", "  "), (9, "", "b"), (10, "text", None)], "id int, a string, h string")
    got = {r.id: r for r in R.summary_features(d, "id", "a", "h", PATH, limit, None, (5, 6, 5), mode).collect()}
    assert sorted(got) == [0, 1, 2]
    for i, t in enumerate(texts):
        pieces = [("highlight_prefix", "highlight: ", 0.2, False), ("highlight_body", t, 1.0, False)]
        same(got[i], expected(f"Article:\nArticle {i} on things", pieces, (5, 6, 5), mode, limit))


def listed(items, role, sep, weigh):
    out = []
    for k, x in enumerate(items):
        out += [(sep, ",", 0.5, False)] if k else []
        out.append((f"{role}_{k + 1}", f" {x}", weigh(k, len(items)), weigh is ranked))
    return out


def ranked(k, n):
    return 1.3 if n == 1 else 1.2 * (1 + 0.3 * k / (n - 1))


def test_labels_of_the_three_tasks(spark):
    cats, words = [["world", "us politics", "arts"], ["sports"], [], None], [["elections", "vote-counting in ohio"], ["über alles", "b", "c"], ["x"], ["y"]]
    d = spark.createDataFrame([(i, f"Title {i}", None if i == 1 else f"body {i}", cats[i], words[i]) for i in range(4)], "id int, t string, b string, c array<string>, k array<string>")
    ask = lambda task: {r.id: r for r in R.label_features(d, "id", "t", "b", task, PATH, ["world", "arts"], "c", "k", None, (3,)).collect()}
    prompt = lambda i: f"Allowed: world, arts\nTitle: Title {i}\nBody: {'' if i == 1 else f'body {i}'}"
    got = ask("category")
    assert sorted(got) == [0, 1]
    for i in got:
        same(got[i], expected(prompt(i), [("prefix", "categories:", 0.2, False), *listed(cats[i], "cat_label", "separator", ranked)], (3,), "final_only", None))
    got = ask("keywords")
    assert sorted(got) == [0, 1, 2, 3]
    for i in got:
        same(got[i], expected(prompt(i), [("prefix", "keywords:", 0.2, False), *listed(words[i], "keyword", "separator", ranked)], (3,), "final_only", None))
    got, flat = ask("both"), lambda k, n: 1.0
    assert sorted(got) == [0, 1]
    for i in got:
        pieces = [("cat_prefix", "categories:", 0.2, False), *listed(cats[i], "cat_label", "cat_separator", flat), ("bridge_newline", "\n", 0.5, False)]
        pieces += [("kw_prefix", "keywords:", 0.2, False), *listed(words[i], "keyword", "kw_separator", flat)]
        same(got[i], expected(prompt(i), pieces, (3,), "final_only", None))
    with pytest.raises(ValueError, match="task"):
        ask("other")


def test_separators_take_turns_and_rows_meet_the_contract(spark):
    d = spark.range(1).select("id", F.lit("p").alias("p"), R.both_pieces(F.array(F.lit("a")), F.array(*map(F.lit, "wxyz")), [",", ";"]).alias("x"))
    rows = R.features(d, ["id"], F.col("p"), F.col("x"), PATH)
    assert rows.first()["answer"] == "categories: a\nkeywords: w, x; y, z"
    assert X.violation_counts(rows, 60_000, 512).where("n > 0").isEmpty()
    assert X.inconsistent_rows(rows, "id").isEmpty()
    with pytest.raises(ValueError, match="mode"):
        R.features(d, ["id"], F.col("p"), F.col("x"), PATH, mode="some")


def test_texts_are_encoded_some_at_a_time(monkeypatch):
    """However many texts a batch has; long ones fewer at once."""
    import pyarrow as pa

    from spindrift.functions import tokens

    sizes = []

    class Fake:
        def encode_batch(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return texts

    monkeypatch.setattr(tokens, "load", lambda path: Fake())
    texts = ["a"] * 130 + [None] + ["b" * tokens.CHARS] * 2
    assert [t for some, _ in tokens._encoded("", pa.array(texts)) for t in some] == texts
    assert sizes == [64, 64, 4, 1]
