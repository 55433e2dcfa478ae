"""Removal of repeated byte strings by column-wise construction of sorted suffixes.

A byte goes if some ``LENGTH``-byte string covers it that also starts earlier in the collection
(smaller doc_id, or the same document, earlier).  Every such string (a *window*) has an anchor: the
least hash of its ``GRAM``-byte grams, the leftmost if equal.  Equal windows have equal anchors at
equal offsets, so windows need only be compared where anchors agree, and anchors that occur once
(most of a corpus) settle their windows as unrepeated straight away.

The texts around equal anchors, aligned at the anchor, are then sorted column by column, from the
last to the first: each round inserts one symbol per document fragment, updating the collection's
positional Burrows-Wheeler order and the common prefixes of neighbours.  In a column, neighbours
with a common prefix of ``LENGTH`` or more hold the same window, and the earliest of them stays.
Whole texts would need as many rounds as the longest text has bytes; aligned fragments need
``2 * LENGTH - GRAM``.  Fragments reach a task as sorted shuffle files and are read in sequence.

No key is a hot spot: equal texts are settled by their digest first; equal fragments are reduced
to their earliest map-side (later ones keep nothing and need no row); an anchor that more than
``HOT`` texts hold is settled window by window, by a minimum that is aggregated map-side.

Defined cases: a null or empty text has no bytes and loses none; nothing shorter than ``LENGTH``
repeats.  Rows that repeat a doc_id are documents of their own, ordered by their texts' digests; a
null doc_id comes last.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import textbytes as tb
from spindrift.llm.common import apart, cut

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # gram starts in a window
COLUMNS = LENGTH + SPAN - 1
HOT = 200_000
BATCH = 40_000
CHUNK = 1 << 23


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, anchor, and its gram's hash.
    ``data`` must be shorter than 2**24 bytes."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, tb.U64),)
    at = np.arange(n - GRAM + 1)
    h = tb.range_hashes(data, at, at + GRAM)
    ranked = (h >> tb.U64(24) << tb.U64(24)) | at.astype(tb.U64)
    anchor = (tb.sliding(ranked, SPAN) & tb.U64(0xFFFFFF)).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for end in off[1:].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    start = np.flatnonzero(inside)
    anchor = anchor[start]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, tb.U64),)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)]))
    last = start[np.concatenate([new[1:], [len(start)]]) - 1]
    return start[new], last, anchor[new], h[anchor[new]]


def pack(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Anchor offset, anchor - first and last - first in one long, ordered by the anchor."""
    return anchor << 14 | (anchor - first) << 7 | (last - first)


def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchor = p >> 14
    first = anchor - (p >> 7 & 127)
    return first, first + (p & 127), anchor


def _emit_anchors(batches):
    for batch in batches:
        data, off = tb.arrow_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j in tb.slices(off):
            base, end = int(off[i]), int(off[j])
            for c in range(base, max(base + 1, end - LENGTH + 1), CHUNK):  # one round but for very long texts
                stop = min(end, c + CHUNK + LENGTH - 1)
                local = np.unique(np.clip(off[i : j + 1], c, stop)) - c
                first, last, anchor, gram = anchors(data[c:stop], local)
                row = np.searchsorted(off[i : j + 1], first + c, "right") - 1 + i
                shift = c - off[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row], pa.int64()),
                        pa.array(pack(first + shift, last + shift, anchor + shift), pa.int64()),
                        pa.array(gram.view(np.int64), pa.int64()),
                    ],
                    names=["doc_id", "p", "gram"],
                )


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    return column.flatten().to_numpy(zero_copy_only=False), off


def _emit_fragments(batches):
    """The text around each repeated anchor; of equal fragments in a batch only the earliest."""
    for batch in batches:
        data, off = tb.arrow_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        packs, lists = _flat(batch.column("ps"))
        grams, _ = _flat(batch.column("grams"))
        owner = np.repeat(np.arange(len(ids)), np.diff(lists))
        order = np.lexsort((packs, ids[owner]))
        packs, grams, owner = packs[order].astype(np.int64), grams[order], owner[order]
        first, last, _ = unpack(packs)
        begin = off[owner] + first
        raw, seen, keep, fragments = data.tobytes(), set(), [], []
        for k, (at, size, shape) in enumerate(
            zip(begin.tolist(), (last - first + LENGTH).tolist(), (packs & 16383).tolist(), strict=True)
        ):
            fragment = raw[at : at + size]
            if (shape, fragment) not in seen:
                seen.add((shape, fragment))
                keep.append(k)
                fragments.append(fragment)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[owner[keep]], pa.int64()),
                pa.array(packs[keep], pa.int64()),
                pa.array(grams[keep], pa.int64()),
                pa.array(fragments, pa.binary()),
            ],
            names=["doc_id", "p", "gram", "fragment"],
        )


def kept_windows(cells: np.ndarray, valid_from: np.ndarray, valid_to: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For aligned fragments, which windows are the earliest of their kind.

    ``cells``: (COLUMNS, fragments) bytes, the anchor at column SPAN - 1; ``rank``: the fragments'
    order in the collection; windows start in columns valid_from to valid_to.  Returns booleans
    (fragments, SPAN).  One symbol of every fragment is inserted per round, last column first.
    """
    m = cells.shape[1]
    kept = np.zeros((m, SPAN), bool)
    order, lcp = np.arange(m), np.zeros(m, np.uint8)
    log = np.zeros(m + 1, np.int64)
    for k in range(2, m + 1):
        log[k] = log[k >> 1] + 1
    levels = int(log[m]) + 1
    for c in range(COLUMNS - 1, -1, -1):
        symbol = cells[c][order]
        move = np.argsort(symbol, kind="stable")
        least = np.zeros((levels, m), np.uint8)
        least[0] = lcp
        for k in range(1, levels):
            w = 1 << (k - 1)
            least[k, : m - w] = np.minimum(least[k - 1, : m - w], least[k - 1, w:])
        a, b = move[:-1] + 1, move[1:]  # the common prefix is the least of those in between
        k = log[np.maximum(b - a + 1, 1)]
        right = np.maximum(b - (1 << k) + 1, 0)
        between = np.minimum(least[k, np.minimum(a, m - 1)], least[k, right])
        moved = symbol[move]
        fresh = np.zeros(m, np.uint8)
        fresh[1:] = np.where(moved[1:] == moved[:-1], between + 1, 0)
        order, lcp = order[move], fresh
        if c < SPAN:
            heads = np.flatnonzero(lcp < LENGTH)
            here = (valid_from[order] <= c) & (c <= valid_to[order])
            ranks = np.where(here, rank[order], m)
            best = np.minimum.reduceat(ranks, heads)
            at = np.repeat(best, np.diff(np.concatenate([heads, [m]])))
            kept[order[here & (ranks == at)], c] = True
    return kept


def _settle(fragments: list[bytes], p: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept windows of a batch of fragments, as packed bits by window, and where there are any."""
    first, last, anchor = unpack(p)
    cells = np.full((len(fragments), COLUMNS), 255, np.uint8)
    left = SPAN - 1 - (anchor - first)
    for k, f in enumerate(fragments):
        cells[k, left[k] : left[k] + len(f)] = np.frombuffer(f, np.uint8)
    rank = np.empty(len(p), np.int64)
    rank[np.lexsort((p, doc))] = np.arange(len(p))
    kept = kept_windows(np.ascontiguousarray(cells.T), left, left + last - first, rank)
    return kept, left


def _emit_kept(batches):
    """Fragments sorted by gram -> (doc_id, p, bits): windows that stay, by offset from the first."""

    def flush(rows):
        doc = np.array([r[0] for r in rows], np.int64)
        p = np.array([r[1] for r in rows], np.int64)
        kept, left = _settle([r[2] for r in rows], p, doc)
        some = np.flatnonzero(kept.any(1))
        bits = [np.packbits(np.roll(kept[k], -left[k])).tobytes() for k in some]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[some], pa.int64()), pa.array(p[some], pa.int64()), pa.array(bits, pa.binary())],
            names=["doc_id", "p", "bits"],
        )

    rows, gram = [], None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("gram", "doc_id", "p", "fragment")]
        for g, d, p, f in zip(*cols, strict=True):
            if g != gram and len(rows) >= BATCH:
                yield flush(rows)
                rows = []
            gram = g
            rows.append((d, p, f))
    if rows:
        yield flush(rows)


def _finish(batches):
    """Texts with their repeated anchors and kept windows -> the digest columns."""
    for batch in batches:
        data, off = tb.arrow_bytes(batch.column("text"))
        packs, pl = _flat(batch.column("ps"))
        kp, kl = _flat(batch.column("kept_p"))
        kept_bits = [b for x in batch.column("kept_bits").to_pylist() for b in (x or ())]
        is_rep = batch.column("rep").to_pylist()
        out = []
        for r in range(batch.num_rows):
            text = data[off[r] : off[r + 1]]
            n = len(text)
            if not is_rep[r]:
                gone = np.full(n, n >= LENGTH)
            else:
                window = np.zeros(n + 1, np.int32)
                a, b, _ = unpack(packs[pl[r] : pl[r + 1]].astype(np.int64))
                np.add.at(window, a, 1)
                np.add.at(window, b + 1, -1)
                window = np.cumsum(window) > 0
                for k in range(int(kl[r]), int(kl[r + 1])):
                    s = int(unpack(np.array([int(kp[k])]))[0][0])
                    window[s + np.flatnonzero(np.unpackbits(np.frombuffer(kept_bits[k], np.uint8)))] = False
                starts = np.flatnonzero(window)
                cover = np.zeros(n + LENGTH + 1, np.int32)
                cover[starts] += 1
                cover[starts + LENGTH] -= 1
                gone = np.cumsum(cover)[:n] > 0
            edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
            out.append((n, int(gone.sum()), edges, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _repeated(d: DataFrame) -> bool:
    return not d.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()


def _in_order(d: DataFrame) -> DataFrame:
    """For a table with repeated or null ids: its different (doc_id, text) pairs as own, text and
    copies, with doc_id their place in the collection.

    Pairs are dealt in ranges and numbered inside a range, so no task holds the table; a pair's
    copies are one row, and a text only moves to its pair's place.
    """
    order = (F.col("own").isNull(), F.col("own"), F.col("digest"))
    pairs = d.select(F.col("doc_id").alias("own"), F.md5("text").alias("digest")).groupBy("own", "digest").agg(F.count("*").alias("copies"))
    pairs = cut(pairs.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = pairs.groupBy("range").agg(F.count("*").alias("n"))  # a row a partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    pairs = pairs.withColumn("n1", place).join(F.broadcast(counts), "range").select(
        "own", "digest", "copies", (F.col("n0") + F.col("n1")).cast("long").alias("place")
    )
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.md5("text") == F.col("digest"))
    texts = d.join(apart(cut(pairs), "digest"), same)
    return cut(texts.select("own", "copies", F.col("place").alias("doc_id"), "text").dropDuplicates(["doc_id"]))


def _gone(text: Column) -> list[Column]:
    """The result of a text that an earlier document holds."""
    n = F.octet_length(text).cast("long")
    whole = n >= LENGTH
    return [
        n.alias("n_bytes"), F.when(whole, n).otherwise(0).alias("n_removed"), whole.cast("long").alias("n_spans"),
        F.sha2(F.when(whole, F.lit("")).otherwise(text), 256).alias("kept_sha256"),
    ]


def _where(condition: str) -> list[Column]:
    """The anchors and grams whose entry meets a condition on ``x.hot``."""
    zipped = f"filter(arrays_zip(ps, grams, hot), x -> {condition})"
    return [F.expr(f"transform({zipped}, x -> x.ps)").alias("ps"), F.expr(f"transform({zipped}, x -> x.grams)").alias("grams")]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not _repeated(d):
        return _dedup(d)
    full = _in_order(d)
    result = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    first = _dedup(full.select("doc_id", "text")).join(full.select("doc_id", "own"), "doc_id").select(F.col("own").alias("doc_id"), *result)
    again = full.where("copies > 1").withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
    return first.unionByName(again.select(F.col("own").alias("doc_id"), *_gone(F.col("text"))))


def _dedup(docs: DataFrame) -> DataFrame:
    """``dedup`` of a table (doc_id, text) without nulls, in which no id comes twice."""
    d = docs.where("doc_id IS NOT NULL")  # so that all joins share one exchange of the texts
    reps = d.select("doc_id", F.md5("text").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    reps = reps.select("doc_id", F.lit(True).alias("rep"))
    own = d.hint("shuffle_merge").join(reps.hint("shuffle_merge"), "doc_id").select("doc_id", "text")
    seen = own.mapInArrow(_emit_anchors, "doc_id long, p long, gram long")
    twice = seen.groupBy("gram").count().where("count > 1")
    again = (
        seen.join(apart(twice, "gram").hint("shuffle_merge"), "gram")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("p", "gram", (F.col("count") > HOT).alias("hot"))).alias("x"))
        .select("doc_id", F.col("x.p").alias("ps"), F.col("x.gram").alias("grams"), F.col("x.hot").alias("hot"))
    )
    around = own.join(again.hint("shuffle_merge"), "doc_id")
    fragment = "doc_id long, p long, gram long, fragment binary"
    cold = (
        around.select("doc_id", "text", *_where("NOT x.hot")).mapInArrow(_emit_fragments, fragment)
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_emit_kept, "doc_id long, p long, bits binary")
    )
    windows = (
        around.where(F.exists("hot", lambda h: h)).select("doc_id", "text", *_where("x.hot"))
        .mapInArrow(_emit_fragments, fragment)
        .select("doc_id", "p", "fragment", F.explode(F.sequence(F.lit(0), F.col("p").bitwiseAND(F.lit(127)).cast("int"))).alias("i"))
    )
    earliest = windows.groupBy(F.substr("fragment", F.col("i") + 1, F.lit(LENGTH)).alias("window")).agg(
        F.min(F.struct("doc_id", "p", "i")).alias("at")
    )
    warm = earliest.groupBy("at.doc_id", "at.p").agg(F.collect_set("at.i").alias("i"))
    warm = warm.mapInArrow(_bits_of, "doc_id long, p long, bits binary")
    kept = cold.unionAll(warm).groupBy("doc_id").agg(F.collect_list(F.struct("p", "bits")).alias("kept"))
    kept = kept.select("doc_id", F.col("kept.p").alias("kept_p"), F.col("kept.bits").alias("kept_bits"))
    ready = (
        d.hint("shuffle_merge").join(reps.hint("shuffle_merge"), "doc_id", "left")
        .join(again.hint("shuffle_merge"), "doc_id", "left")
        .join(kept.hint("shuffle_merge"), "doc_id", "left")
        .select("doc_id", "text", F.coalesce("rep", F.lit(False)).alias("rep"), "ps", "kept_p", "kept_bits")
    )
    return ready.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _bits_of(batches):
    for batch in batches:
        bits = []
        for i in batch.column("i").to_pylist():
            row = np.zeros(SPAN, np.uint8)
            row[i] = 1
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("p"), pa.array(bits, pa.binary())], names=["doc_id", "p", "bits"]
        )


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of texts in order, for tests."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - LENGTH + 1):
            w = b[s : s + LENGTH]
            if w in seen:
                gone[s : s + LENGTH] = True
            seen.add(w)
        edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out
