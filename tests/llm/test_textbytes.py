"""Byte-level helpers against plain Python, on generated texts."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import suffix_dedup, textbytes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 é\n\t.日", max_size=40)), max_size=12)


def words(texts, lower, pattern):
    out = []
    for t in texts:
        t = t or ""
        if lower:
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        out.append(re.findall(pattern, t))
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    data, off = textbytes.arrow_bytes(pa.array(texts, pa.string()))
    for table, lower, pattern in (
        (textbytes.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
        (textbytes.SPACED, False, r"[^\x20\x09-\x0D]+"),
    ):
        d = textbytes.LOWER[data] if lower else data
        starts, ends, woff = textbytes.word_ranges(d, off, table)
        got = [[d[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(woff[:-1], woff[1:], strict=True)]
        want = words(texts, lower, pattern)
        assert got == want
        flat = [w for x in want for w in x]
        h = textbytes.range_hashes(d, starts, ends).tolist()
        assert len(set(h)) == len(set(flat)) and all((h[0] == x) == (flat[0] == w) for x, w in zip(h, flat, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 12))
def test_sliding(values, w):
    v = np.array(values, np.uint64)
    if len(v) >= w:
        assert textbytes.sliding(v, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=260), min_size=1, max_size=4))
def test_every_window_has_one_anchor(texts):
    data, off = textbytes.arrow_bytes(pa.array(texts, pa.string()))
    first, last, anchor, gram = suffix_dedup.anchors(data, off)
    starts = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
    want = [s for a, b in zip(off[:-1], off[1:], strict=True) for s in range(a, b - suffix_dedup.LENGTH + 1)]
    assert starts == want
    assert all(0 <= c - a < suffix_dedup.SPAN and 0 <= c - b for a, b, c in zip(first, last, anchor, strict=True))
    p = suffix_dedup.pack(first, last, anchor)
    assert [x.tolist() for x in suffix_dedup.unpack(p)] == [first.tolist(), last.tolist(), anchor.tolist()]
    content: dict[bytes, tuple] = {}
    for a, b, c, g in zip(first.tolist(), last.tolist(), anchor.tolist(), gram.tolist(), strict=True):
        for s in range(a, b + 1):
            w = data[s : s + suffix_dedup.LENGTH].tobytes()
            assert content.setdefault(w, (c - s, g)) == (c - s, g)


def test_slices_cover_all_rows():
    off = np.array([0, 5, 5, 300, 301, 302])
    got = list(textbytes.slices(off, 10))
    assert got[0][0] == 0 and got[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_sliced_and_large_arrays():
    a = pa.array(["xx", None, "é", "z"], pa.string())
    for x in (a[1:], a[1:].cast(pa.large_string())):
        data, off = textbytes.arrow_bytes(x)
        assert data.tobytes().decode() == "éz" and off.tolist() == [0, 0, 2, 3]
