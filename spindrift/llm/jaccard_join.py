"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

A document is its set of five-word shingles.  Each of ``TREES`` trees gives it a label, a row of
``FULL_DEPTH`` min-hashes; sorted by label, the documents of a tree form a trie.  Two documents
whose labels agree in their first k hashes match at depth k, and at similarity s do so in some tree
with probability 1 - (1 - s^k)^trees.

**Shortening.**  Prefixes start at full length.  A document's prefix is shortened, one hash at a
time, while it has fewer than ``ENOUGH`` plausible partners in its subtree, down to the depth that
reaches the recall target for a single pair at the threshold (``least_depth``).  One that has so
many is *dense* and needs no shorter prefix: a further document that is at the threshold with all
of them misses every one with probability (1 - s^k)^(trees * ENOUGH), far below what is left at the
least depth.  A partner is plausible if the 256 one-bit min-hashes of both (the low bits of the
labels) agree as often as two documents at the threshold do, but for one such pair in ten million.

**Verification.**  What a subtree hands on is linear in its documents: a sparse document's pairs
(fewer than ``ENOUGH`` a tree and depth), and a spanning forest of the dense ones.  Small components of these
candidates are verified in one block.  In a larger one, dense documents are verified block against
block inside their own dense component, and the others pair by pair: only texts of candidate pairs
travel, so a chain of weakly similar texts costs as much as its candidate pairs and no more.

Equal texts are one node.  A subtree of more than ``HOT_BUCKET`` documents at the least depth is
tied to its least node by an aggregate, and so is dense as a whole: no task holds it, and no pair
of it is lost.

Defined cases: a text without words (null, empty, blank) has no shingles: it is a class of its
own with its equal texts and has no links.  A text of one to four words is a single shingle.
Rows that repeat a doc_id are nodes by their texts.  An empty table gives an empty result; columns
beyond doc_id and text are ignored.  A null doc_id counts as the largest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textbytes as tb
from spindrift.llm.common import apart, cut
from spindrift.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, FULL_DEPTH = 32, 8
RECALL = 0.99999
#: Hashes of a label that a trie row carries below its bucket's prefix.
BELOW = 4
#: Plausible partners in one subtree after which a prefix isn't shortened further.
ENOUGH = 8
#: Documents of one subtree that a task looks at together; larger subtrees are tied by an aggregate.
HOT_BUCKET = 512
#: A block of a component: so many texts and so many shingles at most, on average.
BLOCK_NODES, BLOCK_SHINGLES = 128, 400_000


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, full: int = FULL_DEPTH, recall: float = RECALL) -> int:
    """The longest matched prefix that still reaches the recall for one pair at the threshold."""
    depth = full
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_agreement(threshold: float = THRESHOLD, bits: int = TREES * FULL_DEPTH) -> int:
    """How many one-bit min-hashes agree, at least, for a pair to be plausible (5.2 deviations
    below what a pair at the threshold has on average)."""
    p = (1 + threshold) / 2
    return int(bits * p - 5.2 * (bits * p * (1 - p)) ** 0.5)


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and each text's offset among them."""
    starts, ends, woff = tb.word_ranges(data, off, tb.SPACED)
    words = tb.range_hashes(data, starts, ends)
    g, ok = tb.grams(words, woff, k)
    size = np.diff(woff)
    for r in np.flatnonzero((size > 0) & (size < k)):
        a, b = int(woff[r]), int(woff[r + 1])
        g[a] = tb.grams(words[a:b], np.array([0, b - a]), b - a)[0][0]
        ok[a] = True
    total = np.concatenate([[0], np.cumsum(ok)])
    return g[ok], total[woff]


def labels_of(sh: np.ndarray, off: np.ndarray, trees: int = TREES, full: int = FULL_DEPTH, seed: int = 97) -> np.ndarray:
    """For each text its trees' labels: uint16 of shape (texts, trees, full)."""
    rng = np.random.default_rng(seed)
    n = trees * full
    mult = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    out = np.zeros((len(off) - 1, n), np.uint16)
    some = np.flatnonzero(np.diff(off) > 0)
    if not len(some):
        return out.reshape(-1, trees, full)
    low, high = (sh & tb.U64(0xFFFFFFFF)).astype(np.uint32), (sh >> tb.U64(32)).astype(np.uint32)
    begin = off[:-1][some]
    for k in range(n):
        x = low * mult[k] + add[k]
        x ^= high
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        least = np.minimum.reduceat(x, begin)
        least *= np.uint32(0x846CA68B)
        out[some, k] = (least >> np.uint32(16)).astype(np.uint16)
    return out.reshape(-1, trees, full)


def _signatures(batches):
    for batch in batches:
        data, off = tb.arrow_bytes(batch.column("text"))
        labels, sizes = [], []
        for i, j in tb.slices(off, 1 << 19):
            sh, soff = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.diff(soff)
            rows = labels_of(sh, soff).astype(">u2")  # bytes in the order of the trie
            labels += [x.tobytes() if k else None for x, k in zip(rows, n, strict=True)]
            sizes += n.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())],
            names=["doc_id", "node", "n", "labels"],
        )


def _leaves(depth: int):
    """Nodes with their shared (tree, bucket) entries -> one trie row each, with the label below
    the bucket and the sketch."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = np.frombuffer(b"".join(batch.column("labels").to_pylist()), ">u2").reshape(-1, TREES, FULL_DEPTH)
            sketch = np.packbits((labels & 1).astype(np.uint8).reshape(len(labels), -1), axis=1)
            held = batch.column("held")
            size = np.array([len(x) for x in held.to_pylist()])
            owner = np.repeat(np.arange(len(size)), size)
            flat = held.flatten()
            tree = flat.field("tree").to_numpy(zero_copy_only=False)
            below = np.zeros(len(owner), np.uint64)
            for k in range(BELOW):
                below <<= np.uint64(16)
                if depth + k < FULL_DEPTH:
                    below |= labels[owner, tree, depth + k].astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("bucket"),
                    pa.array(below.view(np.int64), pa.int64()),
                    batch.column("node").take(pa.array(owner)),
                    pa.array([x.tobytes() for x in sketch[owner]], pa.binary()),
                ],
                names=["bucket", "below", "node", "sketch"],
            )

    return run


def forest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes is connected with by the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    return root


def descend(bucket: np.ndarray, below: np.ndarray, sketch: np.ndarray, depth: int, agree: int, enough: int = ENOUGH):
    """Candidates among trie rows sorted by (bucket, below): pairs (i, j) of which i is sparse, and
    links (i, root) that span the dense rows.  ``below`` holds the label under the bucket's prefix
    of ``depth`` hashes; ``sketch`` is uint64 of shape (rows, words)."""
    n, found = len(bucket), []
    rows = np.arange(n)
    for lag in range(1, n):  # as far as the largest bucket reaches
        rows = rows[: np.searchsorted(rows, n - lag)]
        rows = rows[bucket[rows] == bucket[rows + lag]]
        if not len(rows):
            break
        same = np.bitwise_count(~(sketch[rows] ^ sketch[rows + lag])).sum(1) >= agree
        found.append(np.stack([rows[same], rows[same] + lag]))
    i, j = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    x = below[i] ^ below[j]
    full = min(FULL_DEPTH, depth + BELOW)
    lcp = np.full(len(i), depth)
    for k in range(full - depth):  # 16 bits for each hash, the first at the top
        lcp += x >> np.uint64(16 * (BELOW - 1 - k)) == 0
    stop = np.full(n, depth)
    settled = np.zeros(n, bool)
    for k in range(full, depth - 1, -1):
        at = lcp >= k
        partners = np.bincount(i[at], minlength=n) + np.bincount(j[at], minlength=n)
        fresh = ~settled & (partners >= enough)
        stop[fresh] = k
        settled |= fresh
    dense = settled[i] & settled[j]
    needed = ~dense | (lcp >= stop[i]) | (lcp >= stop[j])
    pair = ~dense
    a, b = i[pair], j[pair]
    swap = settled[a]  # the sparse end first
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    core = dense & needed
    root = forest_of(n, i[core], j[core])
    inner = np.flatnonzero(root != np.arange(n))
    return a, b, inner, root[inner]


def _candidates(depth: int, agree: int):
    """Trie rows sorted by (bucket, below) -> links (a, b, dense)."""

    def flush(parts):
        bucket, below, node = (np.concatenate([p[k] for p in parts]) for k in range(3))
        sketch = np.concatenate([p[3] for p in parts])
        a, b, c, root = descend(bucket, below, sketch, depth, agree)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[a], node[c]]), pa.int64()),
                pa.array(np.concatenate([node[b], node[root]]), pa.int64()),
                pa.array(np.concatenate([np.zeros(len(a), bool), np.ones(len(c), bool)]), pa.bool_()),
            ],
            names=["a", "b", "dense"],
        )

    def run(batches):
        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, below, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "below", "node"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(bucket), -1)
            rows = (bucket, below.view(np.uint64), node, sketch)
            last = int(np.searchsorted(bucket, bucket[-1], "left"))  # the last bucket may go on in the next batch
            if last:
                yield flush([*kept, tuple(x[:last] for x in rows)])
                kept = []
            kept.append(tuple(x[last:] for x in rows))
            if len(kept) > 1 and kept[0][0][0] != kept[-1][0][0]:
                yield flush(kept[:-1])
                kept = kept[-1:]
        if kept:
            yield flush(kept)

    return run


def candidates(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, dense): candidate pairs with the sparse node first, and links that span the dense
    nodes; ``nodes`` has node (a long) and labels.  A bucket goes by a hash of its tree and prefix:
    a collision can only add candidates."""
    depth = least_depth(threshold)
    rows = nodes.where("labels IS NOT NULL").select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(TREES - 1)),
                lambda t: F.struct(
                    t.cast("byte").alias("tree"),
                    F.xxhash64(t, F.substr("labels", t * 2 * FULL_DEPTH + 1, F.lit(2 * depth))).alias("bucket"),
                ),
            )
        ).alias("at"),
    )
    rows = rows.select("node", "at.tree", "at.bucket")
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    shared = cut(rows.join(apart(buckets, "bucket"), "bucket"))
    hot = shared.where((F.col("c") > HOT_BUCKET) & (F.col("node") != F.col("hub")))
    held = shared.where(F.col("c") <= HOT_BUCKET).groupBy("node").agg(F.collect_list(F.struct("tree", "bucket")).alias("held"))
    leaves = held.join(nodes, "node").select("node", "labels", "held").mapInArrow(
        _leaves(depth), "bucket long, below long, node long, sketch binary"
    )
    found = (
        leaves.repartition("bucket")
        .sortWithinPartitions("bucket", "below", "node")
        .mapInArrow(_candidates(depth, least_agreement(threshold)), "a long, b long, dense boolean")
    )
    return found.unionAll(hot.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.lit(True).alias("dense")))


def _pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: which of ``left`` are at the threshold or above with which of ``right``."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~(new & np.concatenate([new[1:], [True]]))  # a shingle of one text alone joins nothing
    ident, owner = np.cumsum(new)[shared], owner[shared]
    both = np.zeros((len(left), len(right)), np.int64)
    if len(ident):
        ident = np.cumsum(np.concatenate([[0], ident[1:] != ident[:-1]]))
        place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
        place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
        for c in range(0, int(ident[-1]) + 1, 2048):
            a, b = np.searchsorted(ident, [c, c + 2048])
            col, own = ident[a:b] - c, owner[a:b]
            x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
            at = place_l[own] >= 0
            x[place_l[own[at]], col[at]] = 1
            at = place_r[own] >= 0
            y[place_r[own[at]], col[at]] = 1
            both += (x @ y.T).astype(np.int64)  # at most 2,048 ones each, so exact
    union = size[left][:, None] + size[right][None, :] - both
    return (both * 1000 >= round(threshold * 1000) * union) & (both > 0)


def verify_block(sets: list[np.ndarray], block: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Link counts of the texts of blocks i and j, and each text's root (index) in the pair's forest."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    n = len(sets)
    ok = _pairs(sets, left, right, threshold)
    if i == j:
        np.fill_diagonal(ok, False)
        count = ok.sum(1)
        links = np.zeros(n, np.int64)
        links[left] = count
    else:
        links = np.zeros(n, np.int64)
        links[left] += ok.sum(1)
        links[right] += ok.sum(0)
    adjacent = np.zeros((n, n), bool)
    adjacent[np.ix_(left, right)] = ok
    adjacent |= adjacent.T
    root = np.full(n, -1)
    for s in range(n):
        if root[s] < 0:
            front = np.zeros(n, bool)
            front[s] = True
            seen = front.copy()
            while front.any():
                front = adjacent[front].any(0) & ~seen
                seen |= front
            root[seen] = s
    return links, root


def _verify(threshold: float):
    """Arrow batches sorted by (task, bi, bj), one row per text and block pair -> links and roots."""
    cols = ["node", "doc_id", "task", "bi", "bj", "block", "whole"]

    def flush(key, rows):
        data, off = tb.arrow_bytes(pa.array([t for *_, t in rows], pa.large_string()))
        sets = []
        for i, j in tb.slices(off):
            sh, soff = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sets += [np.unique(sh[a:b]) for a, b in zip(soff[:-1], soff[1:], strict=True)]
        block = np.array([r[2] for r in rows])
        links, root = verify_block(sets, block, key[1], key[2], threshold)
        for k, r in enumerate(rows):
            top = rows[root[k]]
            yield r[0], int(links[k]), top[0], r[3]

    def emit(out):
        a, b, c, d = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.bool_())],
            names=["node", "links", "top", "whole"],
        )

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            got = [batch.column(c).to_pylist() for c in cols]
            texts = batch.column("text")
            for k, (node, doc, task, bi, bj, block, whole) in enumerate(zip(*got, strict=True)):
                if (task, bi, bj) != key:
                    if rows:
                        out += flush(key, rows)
                    key, rows = (task, bi, bj), []
                    if len(out) > 5000:
                        yield emit(out)
                        out = []
                rows.append((node, doc, block, whole, texts[k].as_py()))
        if rows:
            out += flush(key, rows)
        if out:
            yield emit(out)

    return run


def _parts(g: str, s: str):
    """In how many blocks ``g`` texts with ``s`` shingles are dealt."""
    return F.greatest(F.lit(1), F.ceil(F.col(g) / BLOCK_NODES), F.ceil(F.col(s) / BLOCK_SHINGLES)).cast("int")


def tasks_of(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(short, task, whole, block, bi, bj): which nodes are compared in which task, blocks bi and bj of it
    with each other.  ``nodes`` has short (its 64-bit id), n (shingles) and labels.

    A component of one block is a task (whole).  In a larger one a dense component is dealt as pairs of
    blocks, and every sparse node is a task with its partners (the node as block 0, they as 1).
    """
    found = cut(candidates(nodes.select(F.col("short").alias("node"), "labels"), threshold).distinct())
    groups = cut(components(found).withColumnRenamed("node", "short"))
    sized = groups.join(nodes.select("short", "n"), "short")
    parts = sized.groupBy("root").agg(F.count("*").alias("g"), F.sum("n").alias("s")).select("root", _parts("g", "s").alias("m"))
    sized = cut(sized.join(apart(parts, "root"), "root"))
    small = sized.where("m = 1").select(
        "short", F.xxhash64(F.lit(0), "root").alias("task"), F.lit(True).alias("whole"), F.lit(0).alias("block"), F.lit(0).alias("bi"), F.lit(0).alias("bj")
    )
    large = sized.where("m > 1")
    if large.isEmpty():
        return small
    links = cut(found.join(large.select(F.col("short").alias("a")), "a"))
    cores = cut(components(links.where("dense")).withColumnRenamed("node", "short"))
    inner = cores.join(large.select("short", "n"), "short")
    blocks = inner.groupBy("root").agg(F.count("*").alias("g"), F.sum("n").alias("s")).select("root", _parts("g", "s").alias("m"))
    inner = inner.join(apart(blocks, "root"), "root")
    inner = inner.withColumn("block", F.pmod(F.xxhash64("short"), F.col("m")).cast("int"))
    inner = inner.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    inner = inner.select(
        "short", F.xxhash64(F.lit(1), "root").alias("task"), F.lit(False).alias("whole"), "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")
    )
    pairs = links.where("NOT dense").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "a").where("u <> v")
    pairs = pairs.groupBy("u", "v").agg(F.min("a").alias("a"))  # both ends may be sparse
    pairs = pairs.select("a", F.when(F.col("a") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("b"))
    core = lambda end: cores.select(F.col("short").alias(end), F.col("root").alias(f"core_{end}"))
    pairs = pairs.join(core("a"), "a", "left").join(core("b"), "b", "left")
    pairs = cut(pairs.where("core_a IS NULL OR core_b IS NULL OR core_a <> core_b").select("a", "b"))
    task, ends = (F.xxhash64(F.lit(2), "a").alias("task"), F.lit(False).alias("whole")), (F.lit(0).alias("bi"), F.lit(1).alias("bj"))
    hubs = pairs.select("a").distinct().select(F.col("a").alias("short"), *task, F.lit(0).alias("block"), *ends)
    spokes = pairs.select(F.col("b").alias("short"), *task, F.lit(1).alias("block"), *ends)
    return small.unionByName(inner).unionByName(hubs).unionByName(spokes)


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (its text's digest), class (a node), class_id (least doc_id of its class), n_links (different
    texts at the threshold or above) and n_copies (documents with this very text)."""
    far = F.lit((1 << 63) - 1)
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), far).alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    signed = cut(d.mapInArrow(_signatures, "doc_id long, node binary, n long, labels binary"))
    nodes = cut(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.max("n").alias("n"), F.max("labels").alias("labels")
        )
    )
    short = F.xxhash64("node").alias("short")  # ids of 64 bits for the candidates; two texts with one are told apart below
    tasks = cut(tasks_of(nodes.select(short, "n", "labels"), threshold))
    members = nodes.select("node", "rep", short).join(tasks.select("short").distinct(), "short")
    texts = d.join(members.withColumnRenamed("rep", "doc_id"), ["doc_id", "node"]).dropDuplicates(["doc_id", "node"])
    checked = (
        texts.join(tasks, "short")
        .select("node", "doc_id", "task", "whole", "bi", "bj", "block", "text")
        .repartition("task", "bi", "bj")
        .sortWithinPartitions("task", "bi", "bj", "node")
        .mapInArrow(_verify(threshold), "node binary, links long, top binary, whole boolean")
    )
    checked = cut(checked)
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    parted = checked.where("NOT whole")  # the tasks of a component's parts see it only together
    roots = checked.where("whole AND node <> top").select("node", F.col("top").alias("root"))
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    if not parted.isEmpty():
        roots = roots.unionAll(components(parted.select(F.col("node").alias("a"), F.col("top").alias("b"))))
    linked = roots.join(nodes.select("node", "rep"), "node")
    linked = linked.join(linked.groupBy("root").agg(F.min("rep").alias("class_id")), "root").drop("rep")
    info = nodes.select("node", "rep", "n_copies").join(linked, "node", "left").join(links, "node", "left")
    info = info.select(
        "node",
        F.coalesce("root", "node").alias("class"),
        F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n_copies").cast("long").alias("n_copies"),
    )
    info = cut(info)  # the last join then stands alone, and a text with very many copies can be split
    return signed.select("doc_id", "node").join(info, "node").select(
        "doc_id", "node", "class", "class_id", "n_links", "n_copies"
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: the least doc_id of each class."""
    far = F.lit((1 << 63) - 1)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), far).alias("doc_id"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"),
    )
    first = join(docs, threshold).groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("x"))
    return rows.join(first.select("x.doc_id", "x.node"), ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]).select("row.*")


def jaccard_query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document (a null doc_id is null again)."""
    own = lambda c: F.when(F.col(c) < (1 << 63) - 1, F.col(c)).alias(c)
    return join(docs.select("doc_id", "text")).select(own("doc_id"), own("class_id"), "n_links", "n_copies")


#: All pairs by shared shingles; the join's own misses are too unlikely to show here.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT t, min(doc_id) AS rep, count(*) AS n_copies FROM t GROUP BY t),
w AS (SELECT rep, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM n),
s AS (SELECT DISTINCT rep, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS k FROM (SELECT rep, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT rep, count(*) AS z FROM s GROUP BY rep),
c AS (SELECT a.rep AS u, b.rep AS v, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN z a ON a.rep = u JOIN z b ON b.rep = v WHERE 10 * i >= 8 * (a.z + b.z - i)),
r AS (SELECT rep AS u, rep AS v FROM n UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
g AS (SELECT u, min(v) AS class_id FROM r GROUP BY u),
k AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies FROM t JOIN n USING (t) JOIN g ON g.u = rep LEFT JOIN k ON k.u = rep
"""


def brute_force(texts: list[str | None], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(class index, links to different texts) of each text by all pairs, for tests."""
    import re

    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    t = [x or "" for x in texts]
    s = {x: sets(x) for x in t}
    first = {x: t.index(x) for x in s}
    top = {x: x for x in s}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = dict.fromkeys(s, 0)
    keys = sorted(s, key=first.get)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if s[a] and s[b] and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=first.get)
                top[y] = x
    return [(first[find(x)], links[x]) for x in t]
