"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Texts of a batch lie one after the other in one byte array; everything here works on such an array
and its offsets, in slices of bounded size, so a task's memory doesn't depend on how many texts an
Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POW: dict[str, np.ndarray] = {}
TOP = U64(0xFFFFFFFFFFFFFFFF)

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) else column.cast(pa.large_string()).fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if len(_POW.get("up", ())) < n:
        m = max(1 << 20, 1 << (n - 1).bit_length())
        inverse = pow(_B, -1, 1 << 64)
        for name, base in (("up", _B), ("down", inverse)):
            a = np.ones(1, U64)
            while len(a) < m:
                a = np.concatenate([a, a * U64(pow(base, len(a), 1 << 64))])
            _POW[name] = a
    return _POW["up"], _POW["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal bytes, equal hashes."""
    up, down = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=s[1:])
    return mix64((s[ends] - s[starts]) * down[starts])


def word_ranges(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's offset among the words."""
    inside = table[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive entries from each position, and where they stay inside their text."""
    n = len(h)
    ok = np.zeros(n, bool)
    if n < k:
        return np.full(n, TOP), ok
    g = np.zeros(n - k + 1, U64)
    for j in range(k):
        g = g * U64(0xD6E8FEB86659FD93) + h[j : j + n - k + 1]
    out = np.full(n, TOP)
    out[: n - k + 1] = mix64(g)
    ok[:] = True
    for j in range(k - 1):
        at = off[1:] - 1 - j
        ok[at[at >= off[:-1]]] = False
    out[~ok] = TOP
    return out, ok


def sliding(v: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """f over v[i : i + w] for every i that has w entries."""
    n, cur, size = len(v), v, 1
    while size * 2 <= w:
        cur = f(cur[:-size], cur[size:])
        size *= 2
    return f(cur[: n - w + 1], cur[w - size : w - size + n - w + 1])


def winnow(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some window of ``w`` hashes (ties: all of them).

    A window that crosses texts only selects more, never less, so each run of ``w`` valid hashes
    keeps its least one wherever it stands.
    """
    n = len(g)
    if n <= w:
        return np.flatnonzero(ok)
    least = sliding(g, w)
    padded = np.zeros(n + w - 1, U64)
    padded[w - 1 : n] = least
    return np.flatnonzero(ok & (sliding(padded, w, np.maximum) == g))
