"""Benchmark decontamination by winnowing.

Both sides keep the least hash of every run of ``WINDOW - K + 1`` consecutive K-word grams, so any
shared span of ``WINDOW`` words has a kept gram in common.  A document's kept gram that the
benchmark keeps too is extended to the WINDOW-word windows around it, and these are looked up
among the benchmark's by the hash of all their words; items shorter than a window are one window.
Words and windows are compared by 64-bit hashes.

A benchmark of at most ``BLOCK_BYTES`` is an index that goes to every task, and a document is
judged where it is read.  A larger one stays distributed: its grams and windows go to the tasks as
bitmaps of a fixed size, so one pass over the documents leaves those of their windows that may be
the benchmark's, and these rows, without any text, are joined with the benchmark's windows by
their hash.  Documents are never shuffled, and are read as often whatever the benchmark's size.

Defined cases: a null text, or one without words, has no hit; an item without words has no window;
items that share an id count once; a null item id counts as the empty string.  Repeated rows are
judged each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.llm import textbytes as tb
from spindrift.llm.common import apart, cut

WINDOW = 13
K = 5
BLOCK_BYTES = 16 << 20
#: Contaminated rows of at most so many bytes of keys are broadcast to drop them.
KEYS_BYTES = 8 << 20
#: Bits of a bitmap (2 MB); a larger benchmark fills it more, which leaves more rows to the join.
BITS = 24
_SHIFT = tb.U64(64 - BITS)


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and each text's offset among them."""
    data = tb.LOWER[data]
    starts, ends, woff = tb.word_ranges(data, off, tb.ALNUM)
    return tb.range_hashes(data, starts, ends), woff


def _kept(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept grams."""
    g, ok = tb.grams(words, off, K)
    at = tb.winnow(g, ok, WINDOW - K + 1)
    return at, g[at]


def item_windows(words: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in a window, item, hash) of all windows of the items, by the windows' length."""
    size = np.diff(off)
    g, ok = tb.grams(words, off, WINDOW)
    at = np.flatnonzero(ok)
    yield WINDOW, np.searchsorted(off, at, "right") - 1, g[at]
    for n in range(1, WINDOW):
        item = np.flatnonzero(size == n)
        if len(item):
            g, _ = tb.grams(words, off, n)
            yield n, item, g[off[:-1][item]]


def item_grams(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The kept grams of items that have a whole window."""
    size = np.diff(off)
    at, g = _kept(words, off)
    return np.unique(g[np.repeat(size >= WINDOW, size)[at]])


class Bitmap:
    """Which of 2**BITS values of a hash's top bits occur."""

    def __init__(self, hashes: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.seen = np.zeros(1 << BITS, bool) if bits is None else bits
        if hashes is not None:
            self.seen[(hashes >> _SHIFT).astype(np.int64)] = True

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        return self.seen[(hashes >> _SHIFT).astype(np.int64)]


def doc_windows(words: np.ndarray, off: np.ndarray, grams: Bitmap, lengths) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in a window, start, hash) of the documents' windows that hold a kept gram of the
    benchmark, and of all runs of words as long as its short items."""
    for n in lengths:
        if n < WINDOW:
            g, ok = tb.grams(words, off, n)
            at = np.flatnonzero(ok)
            yield n, at, g[at]
            continue
        at, g = _kept(words, off)
        at = at[grams.may_hold(g)]
        if len(at):
            near = np.zeros(len(words), bool)
            for back in range(WINDOW - K + 1):
                near[at[at >= back] - back] = True
            g, ok = tb.grams(words, off, WINDOW)
            at = np.flatnonzero(near & ok)
            yield n, at, g[at]


class Index:
    """The windows of a small benchmark: hashes by length, each with its items."""

    def __init__(self, items: list[tuple[str, str]]):
        words, off = _words(*tb.arrow_bytes(pa.array([t for _, t in items], pa.large_string())))
        self.ids = np.array([i for i, _ in items], object)
        self.grams = Bitmap(item_grams(words, off))
        self.windows = {}
        for n, item, h in item_windows(words, off):
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])) if len(h) else order
            h, item = h[new], item[new]
            keys, first = np.unique(h, return_index=True)
            self.windows[n] = (keys, np.concatenate([first, [len(h)]]), item)

    def match(self, words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are in occurring windows, and the items of each text."""
        edge, found = np.zeros(len(words) + 1, np.int64), [set() for _ in range(len(off) - 1)]
        for n, at, h in doc_windows(words, off, self.grams, self.windows):
            keys, first, item = self.windows[n]
            if not len(keys):
                continue
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            at, k = at[hit], k[hit]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            rows = np.searchsorted(off, at, "right") - 1
            for row, x in np.unique(np.stack([rows, k], 1), axis=0).tolist():  # each text's different windows
                found[row].update(self.ids[item[first[x] : first[x + 1]]])
        return np.cumsum(edge[:-1]) > 0, found


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judged(index: Index, own: str):
    """Documents -> own and the digest columns."""

    def run(batches):
        for batch in batches:
            data, off = tb.arrow_bytes(batch.column("text"))
            counts, hits, items = [], [], []
            for i, j in tb.slices(off):
                words, woff = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                hit, found = index.match(words, woff)
                total = np.concatenate([[0], np.cumsum(hit)])
                counts += np.diff(woff).tolist()
                hits += np.diff(total[woff]).tolist()
                items += [sorted(x) for x in found]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(own),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array([h > 0 and 20 * h >= n for h, n in zip(hits, counts, strict=True)], pa.bool_()),
                ],
                names=[own, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )


def _item_rows(batches):
    """Items -> (id, n, h): their windows, and their kept grams with n = 0."""
    for batch in batches:
        data, off = tb.arrow_bytes(batch.column("text"))
        for i, j in tb.slices(off):
            words, woff = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            kept = item_grams(words, woff)
            parts = [(0, np.zeros(len(kept), np.int64), kept), *item_windows(words, woff)]
            item = np.concatenate([x for _, x, _ in parts]) + i
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(item)),
                    pa.array(np.concatenate([np.full(len(x), n) for n, x, _ in parts]), pa.int32()),
                    pa.array(np.concatenate([h for *_, h in parts]).view(np.int64), pa.int64()),
                ],
                names=["id", "n", "h"],
            )


def _candidates(grams: Bitmap, windows: dict[int, Bitmap]):
    """Documents -> (key, n_words, at): the windows that the benchmark may hold."""

    def run(batches):
        for batch in batches:
            data, off = tb.arrow_bytes(batch.column("text"))
            counts, at = [], []
            for i, j in tb.slices(off):
                words, woff = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                found = [[] for _ in range(j - i)]
                for n, p, h in doc_windows(words, woff, grams, windows):
                    may = windows[n].may_hold(h)
                    p, h = p[may], h[may].view(np.int64)
                    row = np.searchsorted(woff, p, "right") - 1
                    for r, a, v in zip(row.tolist(), (p - woff[row]).tolist(), h.tolist(), strict=True):
                        found[r].append({"n": n, "p": a, "h": v})
                counts += np.diff(woff).tolist()
                at += found
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(counts, pa.int64()),
                    pa.array(at, pa.list_(pa.struct([("n", pa.int32()), ("p", pa.int64()), ("h", pa.int64())]))),
                ],
                names=["key", "n_words", "at"],
            )

    return run


def _bitmap(hashes: DataFrame) -> Bitmap:
    """A bitmap of the top bits of ``h``, put together on the executors in pieces of 4 KB."""
    place = F.shiftrightunsigned("h", 64 - BITS) + 1  # buckets hold 1 to 32768, 32769 to ...
    pieces = hashes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(1 << BITS, bool)
    for r in pieces.collect():  # at most 2**BITS / 32768 of them
        begin = (r["k"] - 1) << 15
        bits[begin : begin + (1 << 15)] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
    return Bitmap(bits=bits)


def hits_by_join(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs`` (key,
    text), for a benchmark of any size.  Equal keys must have equal texts."""
    rows = cut(_items(benchmark).mapInArrow(_item_rows, "id string, n int, h long"))
    grams = _bitmap(rows.where("n = 0"))
    lengths = sorted(r["n"] for r in rows.where("n > 0").select("n").distinct().collect())  # 1 to WINDOW
    windows = {n: _bitmap(rows.where(F.col("n") == n)) for n in lengths}
    kind = docs.schema["key"].dataType.simpleString()
    seen = cut(
        docs.mapInArrow(_candidates(grams, windows), f"key {kind}, n_words long, at array<struct<n:int,p:long,h:long>>")
    )
    at = seen.where("size(at) > 0").select("key", F.explode("at").alias("x")).select("key", "x.n", "x.p", "x.h").distinct()
    held = rows.where("n > 0").select("id", "n", "h").distinct()
    occurs = held.select("n", "h").distinct().withColumn("yes", F.lit(True))
    # plain exchanges on both sides, so that windows that very many documents hold can be split
    hit = cut(at.join(occurs.repartition(F.xxhash64(F.lit(1), "n", "h")), ["n", "h"]).drop("yes"))
    last = F.max(F.col("p") + F.col("n")).over(_before())
    fresh = F.greatest(F.col("p") + F.col("n") - F.greatest(F.coalesce(last, F.lit(0)), F.col("p")), F.lit(0))
    n_hit = hit.select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    items = hit.select("key", "n", "h").distinct().join(held.repartition(F.xxhash64(F.lit(1), "n", "h")), ["n", "h"])
    items = items.select("key", "id").distinct().groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    found = cut(n_hit.join(items, "key"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return seen.select("key", "n_words").join(apart(found, "key"), "key", "left").select(
        "key",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _before():
    return Window.partitionBy("key").orderBy("p", "n").rowsBetween(Window.unboundedPreceding, -1)


def _small(benchmark: DataFrame, block_bytes: int) -> Index | None:
    """The index of a benchmark of at most ``block_bytes``."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0) > block_bytes:
        return None
    return Index([(r["id"], r["text"]) for r in items.toLocalIterator()])


def _key():
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    index = _small(benchmark, block_bytes)
    if index is not None:
        schema = StructType([docs.schema["doc_id"]] + StructType.fromDDL(DIGEST).fields)
        return docs.select("doc_id", "text").mapInArrow(_judged(index, "doc_id"), schema)
    rows = docs.select("doc_id", F.to_json(_key()).alias("key"), "text")
    found = hits_by_join(rows.select("key", "text"), benchmark).dropDuplicates(["key"])
    return rows.select("doc_id", "key").join(apart(cut(found), "key"), "key").drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    index = _small(benchmark, block_bytes)
    if index is not None:
        rows = docs.select(F.struct("*").alias("row"), "text")
        schema = StructType([rows.schema["row"]] + StructType.fromDDL(DIGEST).fields)
        return rows.mapInArrow(_judged(index, "row"), schema).where("NOT contaminated").select("row.*")
    rows = docs.select(F.struct("*").alias("row"), F.to_json(_key()).alias("key"), "text")
    bad = cut(hits_by_join(rows.select("key", "text"), benchmark).where("contaminated").select("key").distinct())
    small = (bad.agg(F.sum(F.octet_length("key"))).first()[0] or 0) <= KEYS_BYTES
    return rows.join(F.broadcast(bad) if small else apart(bad, "key"), "key", "left_anti").select("row.*")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark
),
win AS (
  SELECT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM iw WHERE len(ws) > 0)
),
len_ AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT rid, i, d.n, k FROM (
    SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k
    FROM (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, len_ WHERE len(ws) >= n)) d
  WHERE k IN (SELECT k FROM win)
),
m AS (SELECT rid, i, occ.n, item_id FROM occ JOIN win ON occ.k = win.k AND occ.n = win.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
