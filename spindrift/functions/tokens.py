"""Token counts, truncation and segments with a public tokenizer; the vocabulary's path is a
parameter and the tokenizer is loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def load(path: str):
    """A byte-level BPE tokenizer from its JSON file; special strings in a text are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


# Texts that are encoded at once: a token takes over a hundred bytes until its numbers are taken out.
TEXTS, CHARS = 64, 1 << 18


def _encoded(path: str, texts: pa.Array) -> Iterator[tuple[list[str | None], list]]:
    """The texts and their encodings, some at a time."""
    some, chars = [], 0
    for x in texts:
        x = x.as_py()
        some.append(x)
        chars += len(x or "")
        if len(some) == TEXTS or chars >= CHARS:
            yield some, load(path).encode_batch([y or "" for y in some], add_special_tokens=False)
            some, chars = [], 0
    if some:
        yield some, load(path).encode_batch([y or "" for y in some], add_special_tokens=False)


def _column(path: str, f: Callable[[list, list], pa.Array], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column of what ``f`` makes of texts and their encodings, in arrays without a Python object a token."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], arrow), *(f(t, e).cast(arrow) for t, e in _encoded(path, texts))])

    return F.arrow_udf(run, kind)


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def count_tokens(c: Column, path: str) -> Column:
    """How many tokens a text has; null has none."""
    return _column(path, lambda _, found: pa.array([len(e.ids) for e in found], pa.int64()), "long", pa.int64())(c)


def token_ids(c: Column, path: str) -> Column:
    def ids(_, found):
        return _lists(pa.array(np.concatenate([np.asarray(e.ids, np.int32) for e in found])), [len(e.ids) for e in found])

    return _column(path, ids, "array<int>", pa.list_(pa.int32()))(c)


def truncate_tokens(c: Column, path: str, limit: int) -> Column:
    """The longest start of a text that holds at most ``limit`` tokens, cut at a token's end."""

    def cut(t, e):
        return t if t is None or len(e.ids) <= limit else t[: e.offsets[limit - 1][1]] if limit > 0 else ""

    return _column(path, lambda texts, found: pa.array([cut(t, e) for t, e in zip(texts, found, strict=True)], pa.string()), "string", pa.string())(c)


def token_segments(c: Column, path: str) -> Column:
    """(start, end) of each token in the text; tokens that share a character's bytes share it."""

    def segments(_, found):
        at = [np.asarray(e.offsets, np.int32).reshape(-1, 2) for e in found]
        every = np.concatenate(at)
        pairs = pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["start", "end"])
        return _lists(pairs, [len(x) for x in at])

    return _column(path, segments, "array<struct<start: int, end: int>>", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))(c)
