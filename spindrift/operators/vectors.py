"""Vectors and graphs: nearest neighbours, similarity graphs, clusters and their representatives."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import blocks

BLOCK = blocks.BLOCK


def cut(df: DataFrame) -> DataFrame:
    """Write to the checkpoint folder that the cluster names and go on from there; where none is
    named, a local run gets one of its own and a cluster one in the shared warehouse."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        local = sc.master == "local" or sc.master.startswith("local[")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="spindrift-") if local else shared))
    return forgetful(df.checkpoint(eager=True))


def forgetful(df: DataFrame) -> DataFrame:
    """A checkpointed table without the size that was guessed for it.  The guess for a join is the
    product of its sides, so in a loop of joins the number of its digits would double every round
    until planning takes longer than the work."""
    spark, jdf = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def knn(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, k: int, include_self: bool = False) -> DataFrame:
    """(src, dst, sim, rank) of the ``k`` largest inner products; ties go to the smaller id.

    Exact: a task holds some blocks of queries and the base passes by, block after block; only the best
    ``k`` of each query leave the task.  Work is rows x rows; disk holds each side once.
    """
    n = queries.count()
    block = max(1, min(BLOCK, -(-n // 48)))
    q = blocks.packed(queries.repartition(max(1, min(48, -(-n // 32)))), id_col, vec_col, block, "q")
    b = blocks.packed(base, id_col, vec_col, BLOCK, "b")
    pairs = blocks.met(b.repartition(16), q)  # blocks, not rows
    return _ranked(pairs.mapInArrow(_nearest(k, include_self), "src long, dst long, sim double"), k)


def _nearest(k: int, include_self: bool, centres: np.ndarray | None = None, probes: int = 0):
    """Pairs of blocks -> the best ``k`` of each query among all blocks that it met; with ``centres``, among
    those of the ``probes`` lists nearest to the query."""

    def run(batches):
        held: dict[int, tuple[blocks.Nearest, np.ndarray | None]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["qb"] not in held:
                    ids = np.frombuffer(r["qi"], np.int64)
                    q = blocks.vectors_of(r["qm"], r["qwide"], len(ids))
                    into = None
                    if centres is not None:
                        into = np.zeros((len(ids), len(centres)), bool)
                        np.put_along_axis(into, nearest_lists(q.astype(float), centres, probes), True, axis=1)
                    held[r["qb"]] = blocks.Nearest(ids, q, k, include_self), into
                best, into = held[r["qb"]]
                ids = np.frombuffer(r["bi"], np.int64)
                best.add(ids, blocks.vectors_of(r["bm"], r["bwide"], len(ids)), None if into is None else np.flatnonzero(into[:, r["blists"][0]]))
        for best, _ in held.values():
            yield best.found()

    return run


def nearest_lists(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def coarse_centres(base: DataFrame, id_col: str, vec_col: str, lists: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``lists`` groups of directions, by spherical k-means over a bounded sample:
    the ``sample`` rows with the least hash of their id."""
    rows = base.select(F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(F.lit(31), id_col).alias("h"))
    x = np.array([r["v"] for r in rows.where("v IS NOT NULL").orderBy("h").limit(max(sample, lists)).collect()], float)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[:lists].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _in_lists(df: DataFrame, id_col: str, vec_col: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, v, list): each row with the ``probes`` lists whose centres are nearest."""

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = np.stack([np.asarray(v.values, float) for v in batch.column("v")])
            best = nearest_lists(x, centres, probes)
            own = pa.array(np.repeat(np.arange(rows), best.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(own), batch.column("v").take(own), pa.array(best.ravel(), pa.int32())], names=["id", "v", "list"]
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    return rows.mapInArrow(run, "id long, v array<double>, list int")


def _probes_for(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, k: int, centres: np.ndarray, held: DataFrame, recall: float, sample: int = 64) -> int:
    """The least number of lists that hold ``recall`` of the neighbours of ``sample`` queries, which
    are searched exactly, in one pass over the base."""
    some = cut(queries.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(F.lit(13), id_col)).limit(sample))
    true = knn(some, base, id_col, vec_col, k).join(held.select(F.col("id").alias("dst"), "list"), "dst").select("src", "list").collect()
    vectors = {r[id_col]: np.asarray(r[vec_col], float) for r in some.collect()}
    place = {i: np.argsort(np.argsort(-(centres @ v), kind="stable")) for i, v in vectors.items()}
    needed = sorted(int(place[r["src"]][r["list"]]) + 1 for r in true)
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def knn_approximate(
    queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, k: int, probes: int | None = None, lists: int | None = None, recall: float = 0.95
) -> DataFrame:
    """Like ``knn`` without comparing all rows: the base lies in lists by nearest centre, a query
    looks only into the ``probes`` lists nearest to it, and what it finds there is ranked exactly.

    Lists grow with the root of the base (sqrt(n) / 3, 4,096 at most), so a query meets about
    3 * probes * sqrt(n) rows.  Without ``probes``, as many lists are looked into as hold ``recall`` of
    the true neighbours of a sample of queries: a few where vectors lie in groups, most of them where
    directions are spread evenly and no index can do without.  Lists are cut into blocks of ``BLOCK`` rows
    that pass the queries, so no query is copied for its lists; every base row lies in exactly one list.
    """
    n = base.count()
    lists = lists or max(1, min(4096, int(n**0.5 / 3)))
    centres = coarse_centres(base, id_col, vec_col, lists)
    if not len(centres):
        return knn(queries, base, id_col, vec_col, k)
    held = cut(_listed(base, id_col, vec_col, centres, BLOCK, "b"))
    probes = probes or _probes_for(queries, base, id_col, vec_col, k, centres, _in_lists(base, id_col, vec_col, centres, 1), recall)
    asked = _listed(queries, id_col, vec_col, centres, max(1, min(BLOCK, -(-queries.count() // 48))), "q", probes)
    pairs = blocks.met(held, asked).where(F.array_contains("qlists", F.get("blists", F.lit(0))))
    return _ranked(pairs.mapInArrow(_nearest(k, False, centres, probes), "src long, dst long, sim double"), k)


def _listed(df: DataFrame, id_col: str, vec_col: str, centres: np.ndarray, block: int, prefix: str, probes: int | None = None) -> DataFrame:
    """Blocks of rows of one list each, and its number; with ``probes``, of rows that have lists near each
    other in order, and the numbers of all lists that one of the rows looks into."""

    def run(batches):
        for list_, batch in _by_list(batches, probes is None):
            for part in blocks.runs(iter([batch]), block):
                x = blocks.matrix(part.column("v"))
                m, wide = blocks.vector_bytes(x)
                into = [list_] if probes is None else np.unique(nearest_lists(x, centres, probes)).tolist()
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([m]), pa.array([wide]), pa.array([into], pa.list_(pa.int32()))], names=["i", "m", "wide", "lists"])

    def own(batches):
        for batch in batches:
            if batch.num_rows:
                best = nearest_lists(blocks.matrix(batch.column("v")), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32())], names=["id", "v", "list"])

    kind = df.schema[vec_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    rows = rows.mapInArrow(own, f"id long, v {kind}, list int")
    rows = rows.repartitionByRange(48, "list", F.xxhash64("id")).sortWithinPartitions("list")  # a full list is many tasks'
    b = rows.mapInArrow(run, "i binary, m binary, wide boolean, lists array<int>")
    return b.select(F.monotonically_increasing_id().alias(f"{prefix}b"), *(F.col(c).alias(f"{prefix}{c}") for c in ("i", "m", "wide", "lists")))


def _by_list(batches, apart: bool):
    """(list, rows) of batches sorted by list; the rows of several lists together unless ``apart``."""
    for batch in batches:
        if not apart:
            yield None, batch
            continue
        own = batch.column("list").to_numpy(zero_copy_only=False)
        ends = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for lo, hi in zip(ends, ends[1:]):
            if hi > lo:
                yield int(own[lo]), batch.slice(lo, hi - lo)


def percentile(df: DataFrame, col: str, q: float, fallback: float) -> DataFrame:
    """One row with the exact linear percentile of the finite values, or the fallback."""
    finite = df.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf")))
    return finite.agg(F.coalesce(F.percentile(col, q), F.lit(fallback)).alias("threshold"))


def undirected(edges: DataFrame, weight: str = "sim") -> DataFrame:
    """One row per unordered pair with its largest weight; self-links go."""
    u, v = F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    return edges.where("src <> dst").groupBy(u, v).agg(F.max(weight).alias("weight"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists too."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def graph_edges(neighbours: DataFrame, q: float, fallback: float, only_mutual: bool, per_node: int) -> DataFrame:
    """Similarity graph: best ``per_node`` edges, at or above the percentile, mutual if asked."""
    e = neighbours.where(F.col("rank") <= per_node)
    e = e.join(F.broadcast(percentile(e, "sim", q, fallback))).where(F.col("sim") >= F.col("threshold"))
    return undirected(mutual(e) if only_mutual else e)


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): least node id reachable; rounds of neighbour minimum and pointer jump, until
    nothing changes."""
    both = cut(edges.select("u", "v").unionAll(edges.select("v", "u")).distinct())
    lab = nodes.select(F.col("node"), F.col("node").alias("component"))
    while True:
        best = both.join(lab, both.v == lab.node).groupBy("u").agg(F.min("component").alias("m"))
        new = lab.join(best, lab.node == best.u, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c1"), F.col("component").alias("old"))
        jump = lab.select(F.col("node").alias("c1"), F.col("component").alias("c2"))
        new = cut(new.join(jump, "c1", "left").select("node", F.least("c1", F.coalesce("c2", "c1")).alias("component"), "old"))
        changed = new.where("component <> old").limit(1).count()
        lab = new.select("node", "component")
        if not changed:
            break
    return lab


def communities(
    edges: DataFrame, nodes: DataFrame, resolutions: tuple[float, ...] = (1.0,), largest: int | None = None, seed: int = 7
) -> DataFrame:
    """(node, cluster) by modularity with a resolution: the partition of the first of the
    ``resolutions`` none of whose clusters has more than ``largest`` nodes, else of the last.

    Any optimiser's labels are its own; what holds is that no cluster reaches beyond a connected
    component, and that the quality is never below that of all nodes apart.
    """
    both = edges.select("u", "v", "weight").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    both = cut(both.groupBy("u", "v").agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    found = None
    for r in resolutions:
        found = _partition(both, nodes, r, seed)
        size = found.groupBy("cluster").count().agg(F.max("count")).first()[0] or 0
        if largest is None or size <= largest:
            break
    return found


def _partition(both: DataFrame, nodes: DataFrame, resolution: float, seed: int) -> DataFrame:
    """Levels of local moves and contraction until a level moves nothing."""
    total = both.agg(F.sum("weight")).first()[0] or 0.0
    member = cut(nodes.select("node", F.col("node").alias("cluster")))
    if total <= 0:
        return member
    level = both
    while True:
        lab, moved = _local_moves(level, total, resolution, seed)
        if not moved:
            return member
        member = member.withColumnRenamed("cluster", "c0").join(lab.select(F.col("node").alias("c0"), "cluster"), "c0", "left")
        member = cut(member.select("node", F.coalesce("cluster", "c0").alias("cluster")))
        ends = [lab.select(F.col("node").alias(x), F.col("cluster").alias(f"c{x}")) for x in ("u", "v")]
        level = level.join(ends[0], "u").join(ends[1], "v").groupBy("cu", "cv").agg(F.sum("weight").alias("weight"))
        level = cut(level.select(F.col("cu").alias("u"), F.col("cv").alias("v"), "weight"))


def _quality(level: DataFrame, lab: DataFrame, total: float, resolution: float) -> float:
    """Modularity of a labelling; self-links hold the weight inside contracted nodes."""
    ends = [lab.select(F.col("node").alias(x), F.col("cluster").alias(f"c{x}")) for x in ("u", "v")]
    e = level.join(ends[0], "u").join(ends[1], "v")
    inside = F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0.0))
    by = e.groupBy("cu").agg(inside.alias("inside"), F.sum("weight").alias("k"))
    return by.agg(F.sum(F.col("inside") / total - resolution * (F.col("k") / total) ** 2)).first()[0] or 0.0


def _local_moves(level: DataFrame, total: float, resolution: float, seed: int, patience: int = 3) -> tuple[DataFrame, bool]:
    """Nodes move to the neighbouring cluster with the largest gain, a seeded half of them a round;
    rounds end when no node gains, or when ``patience`` of them in a row raised the quality by less than
    0.001.  The
    best partition seen is returned, and whether it is better by more than that than all nodes apart."""
    degree = cut(level.groupBy("u").agg(F.sum("weight").alias("k")).withColumnRenamed("u", "node"))
    lab = degree.select("node", F.col("node").alias("cluster"))
    best = start = _quality(level, lab, total, resolution)
    best_lab, since, k = lab, 0, 0
    while since < patience:
        own = lab.join(degree, "node")
        mass = own.groupBy("cluster").agg(F.sum("k").alias("mass"))
        to = level.where("u <> v").join(lab.select(F.col("node").alias("v"), "cluster"), "v").groupBy("u", "cluster").agg(F.sum("weight").alias("w"))
        stay = own.select(F.col("node").alias("u"), "cluster", F.lit(0.0).alias("w"))
        c = to.unionAll(stay).groupBy("u", "cluster").agg(F.sum("w").alias("w")).join(mass, "cluster")
        c = c.join(own.select(F.col("node").alias("u"), F.col("cluster").alias("now"), "k"), "u")
        others = F.col("mass") - F.when(F.col("cluster") == F.col("now"), F.col("k")).otherwise(0.0)
        c = c.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * others / total, 9))
        top = F.max(F.struct("gain", (-F.col("cluster")).alias("c"))).alias("top")
        b = c.groupBy("u", "now").agg(top, F.max(F.when(F.col("cluster") == F.col("now"), F.col("gain"))).alias("held"))
        wants = F.col("top.gain") > F.col("held") + 1e-9
        turn = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "u"), F.lit(2)) == 0
        moves = b.select(F.col("u").alias("node"), F.when(wants & turn, -F.col("top.c")).otherwise(F.col("now")).alias("cluster"), wants.alias("wants"))
        moves = cut(moves)
        k += 1
        if moves.where("wants").isEmpty():
            break
        lab = moves.select("node", "cluster")
        quality = _quality(level, lab, total, resolution)
        since += 1
        if quality > best:
            since = 0 if quality > best + 1e-3 else since
            best, best_lab = quality, lab
    return best_lab, best > start + 1e-3


def attach_singletons(members: DataFrame, neighbours: DataFrame, threshold: float) -> DataFrame:
    """Members (node, cluster) with singletons attached to the cluster of their first neighbour at
    the threshold or above that lies in a cluster of two or more.

    Singletons are decided in ascending order and an attached one counts for later ones; rounds
    decide all whose earlier neighbours are decided, which gives the sequential result.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    m = members.join(size, "cluster").select("node", "cluster", (F.col("size") >= 2).alias("grown"), (F.col("size") >= 2).alias("done"))
    edges = neighbours.where(F.col("sim") >= threshold).select(F.col("src"), F.col("dst"), "rank")
    m = cut(m)
    # frozen sizes: an attached singleton is in a cluster of two or more from then on
    while True:  # the least open singleton is decided in every round
        open_ = m.where("NOT done").select(F.col("node").alias("src"))
        if open_.isEmpty():
            break
        e = edges.join(open_, "src").join(m.select(F.col("node").alias("dst"), F.col("cluster").alias("dc"), F.col("grown").alias("dg"), F.col("done").alias("dd")), "dst")
        waiting = (~F.col("dd")) & (F.col("dst") < F.col("src"))
        g = e.groupBy("src").agg(
            F.min(F.when(F.col("dg"), F.struct("rank", "dc"))).alias("hit"), F.min(F.when(waiting, F.col("rank"))).alias("wait")
        )
        ready = g.where("wait IS NULL OR (hit IS NOT NULL AND hit.rank < wait)").select("src", F.col("hit.dc").alias("to"), F.lit(True).alias("now"))
        none = open_.join(g.select("src"), "src", "left_anti").select("src", F.lit(None).cast("long").alias("to"), F.lit(True).alias("now"))
        r = ready.unionByName(none)
        m = cut(
            m.join(r, m.node == r.src, "left").select(
                "node", F.coalesce("to", "cluster").alias("cluster"), (F.col("grown") | F.col("to").isNotNull()).alias("grown"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")
            )
        )
    return m.select("node", "cluster")


def pair_singletons(members: DataFrame, neighbours: DataFrame, threshold: float) -> DataFrame:
    """Singletons that are each other's neighbours form one cluster, under its least node's label."""
    single = members.join(members.groupBy("cluster").count().where("count = 1"), "cluster").select("node")
    e = neighbours.where(F.col("sim") >= threshold).join(single.withColumnRenamed("node", "src"), "src").join(single.withColumnRenamed("node", "dst"), "dst")
    comp = connected(undirected(mutual(e)).select("u", "v"), single)
    label = members.select(F.col("node").alias("component"), F.col("cluster").alias("label"))
    comp = comp.join(label, "component").select("node", "label")
    return members.join(comp, "node", "left").select("node", F.coalesce("label", "cluster").alias("cluster"))


def centroids(df: DataFrame, cluster: str, vec: str, dim: int) -> DataFrame:
    """(cluster, size, centroid): mean vector scaled to unit length; partial sums are map-side."""
    c = df.groupBy(cluster).agg(F.count("*").alias("size"), F.array(*(F.avg(F.get(vec, F.lit(i)).cast("double")) for i in range(dim))).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return c.withColumn("norm", norm).select(cluster, "size", F.transform("mean", lambda x: x / F.greatest(F.col("norm"), F.lit(1e-12))).alias("centroid"))


def centroid_ranks(df: DataFrame, id_col: str, cluster: str, vec: str, dim: int, digits: int = 9) -> DataFrame:
    """Similarity and distance to the own centroid and the 0-based rank by distance, then id."""
    dot = F.aggregate(F.zip_with(vec, "centroid", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    j = df.join(centroids(df, cluster, vec, dim), cluster).withColumn("sim", F.round(dot, digits))
    j = j.withColumn("dist", F.round(1 - F.col("sim"), digits))
    w = Window.partitionBy(cluster).orderBy("dist", id_col)
    return j.select(id_col, cluster, "size", "sim", "dist", (F.row_number().over(w) - 1).cast("long").alias("rank"))


def gap_representatives(ranked: DataFrame, id_col: str, cluster: str, k: Column, side: str = "right") -> DataFrame:
    """``k`` members per cluster: nearest and farthest, then those at the largest distance gaps;
    equal gaps prefer the farther member.  ``k`` of 1 takes the nearest, of the size or more all."""
    w = Window.partitionBy(cluster).orderBy("rank")
    g = ranked.withColumn("k", k).withColumn("gap", F.lead("dist").over(w) - F.col("dist") if side == "left" else F.col("dist") - F.lag("dist").over(w))
    g = g.withColumn("inner", (F.col("rank") > 0) & (F.col("rank") < F.col("size") - 1))
    order = Window.partitionBy(cluster, "inner").orderBy(F.round("gap", 9).desc_nulls_last(), F.col("rank").desc())
    g = g.withColumn("gap_rank", F.row_number().over(order))
    keep = (
        (F.col("k") >= F.col("size")) | ((F.col("k") == 1) & (F.col("rank") == 0))
        | ((F.col("k") >= 2) & (~F.col("inner") | (F.col("gap_rank") <= F.col("k") - 2)))
    )
    return g.where(keep).select(id_col, cluster, "rank", "dist")
