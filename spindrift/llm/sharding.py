"""Sharding by balanced label propagation.

Documents with equal texts are linked through a hub, the text's hash.  Documents start on a shard
by hash; each round is a Spark join in which the members of a hub ask to move to the shard that
holds most of its bytes, shards near their capacity only if no other holds any.  Requests are summed to a shard-by-shard matrix (at most 64 numbers on
the driver) and granted up to quotas: what flows the other way, plus the target's free capacity.
Rounds end when nothing moves; a hub that is still apart then, or after the last round, goes whole
to the shard that it asks for.  A last pass lays the documents on one line, shard after shard and
hub after hub, and cuts it where each shard is full, so sizes are equal to within one document.

A hub of more than ``1 / LARGE`` of all rows or bytes (fewer than ``2 * LARGE`` of them) is packed
by itself beforehand: whole on one shard, largest first, or, where no shard has room for it, in as
large parts as fit.  So only the hubs at a cut, which hold less than ``1 / LARGE``, and those that
no shard can take lose links.  Prefix sums are two-level, over cells (a bounded number) and inside
a cell; the rows of a hub that is larger than a cell on average are numbered by cells of their own,
and joins on hubs have plain exchanges, so no task need hold a hub.

Defined cases: a null text has size 1, checksum 0 and hub null-hash, like the empty text's group;
rows that repeat a doc_id are placed each on its own; an empty table gives an empty result; other
columns are carried through by ``shard``, whose own replace those of the same names, and ignored by
the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import apart, cut

SHARDS = 8
ROUNDS = 6
LARGE = 256
CELL_BITS = 9


def quotas(
    ask: dict[tuple[int, int], int], load: list[int], capacity: int
) -> tuple[dict[tuple[int, int], float], list[int]]:
    """The share of each (from, to) request that may move, and the loads after it: bytes swap
    pairwise, then flow into free capacity, in order of demand."""
    grant = {k: min(v, ask.get(k[::-1], 0)) for k, v in ask.items()}
    now = list(load)
    for (a, b), v in sorted(ask.items(), key=lambda x: (-x[1], x[0])):
        more = max(0, min(v - grant[a, b], capacity - now[b]))
        grant[a, b] += more
        now[a] -= more
        now[b] += more
    return {k: grant[k] / v for k, v in ask.items() if v > 0}, now


def _unit(*cols: Column) -> Column:
    """A seeded hash in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def pack(
    hubs: list[tuple[int, int, int]], held: dict[tuple[int, int], int], shards: int, total: int
) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """Where the large ``hubs`` (hub, rows, bytes a row) go: parts (hub, shard, first row, end,
    first slot), and the bytes and rows of each shard after it.  A hub that fits a shard's free
    room goes there whole, the largest first, to the shard with the least room that does; with equal
    room, to the one that holds most of it.  What fits no shard fills the freest shards in turn."""
    share, load, rows = total // shards, [0] * shards, [0] * shards
    parts = []

    def put(hub: int, at: int, begin: int, n: int, size: int) -> None:
        parts.append((hub, at, begin, begin + n, rows[at]))
        load[at] += n * size
        rows[at] += n

    for hub, count, size in sorted(hubs, key=lambda h: (-h[1] * h[2], h[0])):
        begin = 0
        while begin < count:
            left = count - begin
            room = [x for x in range(shards) if load[x] + left * size <= share]
            if room:
                put(hub, min(room, key=lambda x: (-load[x], -held.get((hub, x), 0), x)), begin, left, size)
                break
            at = min(range(shards), key=lambda x: (load[x], -held.get((hub, x), 0), x))
            n = min(left, max(1, (share - load[at]) // size))
            put(hub, at, begin, n, size)
            begin += n
    return parts, load, rows


def free_room(load: list[int], rest: int) -> list[int]:
    """``rest`` bytes poured over the shards' ``load`` up to one level: what each takes, in whole
    bytes that sum to ``rest``."""
    order = sorted(load)
    for n in range(1, len(order) + 1):
        level = (rest + sum(order[:n])) / n
        if n == len(order) or level <= order[n]:
            break
    ends = [0.0]
    for x in load:
        ends.append(ends[-1] + max(0.0, level - x))
    whole = [round(e) for e in ends[:-1]] + [rest]
    return [b - a for a, b in zip(whole, whole[1:], strict=False)]


def propagate(state: DataFrame, shards: int, total: int, rounds: int, packed: list[int], slack: float = 0.25) -> DataFrame:
    """Move linked rows of ``state`` (row, size, hub, linked, shard) towards their hubs' shards, one
    join of the linked rows a round.  In the result no hub is on two shards.

    ``slack`` is how far above an equal share a shard may fill between rounds; the cut that follows
    makes sizes equal again without parting a hub, but for those at the seven cuts.
    """
    capacity = int(total / shards * (1 + slack)) + 1
    full: list[int] = []
    alone, linked = state.where("NOT linked"), cut(state.where("linked"))  # the others never move
    resting = {r["shard"]: r["b"] for r in alone.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    resting = {x: resting.get(x, 0) + packed[x] for x in range(shards)}

    def asking() -> DataFrame:
        held = linked.groupBy("hub", "shard").agg(F.sum("size").alias("b"))
        held = held.groupBy("hub").agg(
            F.max(F.struct((~F.col("shard").isin(full)).alias("free"), "b", (-F.col("shard")).alias("s"))).alias("best")
        )
        return linked.join(apart(held.select("hub", (-F.col("best.s")).cast("int").alias("want")), "hub"), "hub")

    for k in range(rounds):
        asked = cut(asking())
        flows = asked.groupBy("shard", "want").agg(F.sum("size").alias("b")).collect()
        load = [resting[x] + sum(r["b"] for r in flows if r["shard"] == x) for x in range(shards)]
        share, load = quotas({(r["shard"], r["want"]): r["b"] for r in flows if r["shard"] != r["want"]}, load, capacity)
        full = [x for x in range(shards) if load[x] > total / shards * (1 + slack / 2)]
        granted = F.lit(0.0)
        for (a, b), v in sorted(share.items()):
            granted = F.when((F.col("shard") == a) & (F.col("want") == b), F.lit(float(v))).otherwise(granted)
        u = _unit(F.lit(k), F.col("hub"))
        linked = asked.withColumn("shard", F.when(u < granted, F.col("want")).otherwise(F.col("shard"))).drop("want")
        if not any(share.values()):
            break
    linked = asking().withColumn("shard", F.col("want")).drop("want")
    return alone.unionByName(linked)


def even_cut(state: DataFrame, shards: int, room: list[int], before: list[int]) -> DataFrame:
    """``state`` with shard cut to the ``room`` of each shard and slot, gapless from ``before``.

    A hub lies in one piece: inside a cell, or, if it holds more rows than a cell does on average
    (``parts`` is above 0), in that many cells of its own.
    """
    s = state.withColumn("place", F.xxhash64(F.lit(3), "hub")).withColumn("own", F.col("parts") > 0)
    s = s.withColumn("cell", F.when(F.col("own"), F.col("hub")).otherwise(F.shiftrightunsigned("place", 64 - CELL_BITS)))
    s = s.withColumn("part", F.when(F.col("own"), F.pmod(F.xxhash64(F.lit(5), "row"), F.col("parts"))).otherwise(0))
    at = ["shard", "own", "cell", "part"]
    cells = s.groupBy(*at).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    line = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*at, F.coalesce(F.sum("b").over(line), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*at).orderBy("place", "hub", "row", "size")
    s = s.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("b1"),
        F.row_number().over(inside).alias("n1"),
    ).join(F.broadcast(cells), at)  # at most 3 * shards * 2**CELL_BITS rows
    middle = F.col("b0") + F.col("b1") + F.expr("size div 2")
    ends = [sum(room[: x + 1]) for x in range(shards - 1)]
    last = max((x for x in range(shards) if room[x]), default=shards - 1)
    cut_at = F.least(F.lit(last), sum(((middle >= e).cast("int") for e in ends), F.lit(0))).cast("int")
    s = s.withColumn("shard", cut_at).withColumn("rank", F.col("n0") + F.col("n1") - 1).drop("b0", "b1", "n0", "n1")
    s = cut(s)
    first = s.groupBy("shard").agg(F.min("rank").alias("first"))
    s = s.join(F.broadcast(first), "shard")
    return s.withColumn("slot", F.col("rank") - F.col("first") + F.get(F.array(*map(F.lit, before)), F.col("shard")))


def numbered(large: DataFrame, counts: dict[int, int], rows: int) -> DataFrame:
    """``large`` with ``nth``, gapless from 0 in each hub; a cell holds about as many rows as one
    of ``even_cut``."""
    cells = SHARDS << CELL_BITS
    salts = F.create_map(*[F.lit(x) for h, n in counts.items() for x in (h, 1 + n * cells // rows)])
    s = large.withColumn("cell", F.pmod(F.xxhash64(F.lit(5), "hub", "row"), salts[F.col("hub")]))
    n0 = s.groupBy("hub", "cell").agg(F.count("*").alias("n"))
    line = Window.partitionBy("hub").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    n0 = n0.select("hub", "cell", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("n0"))
    s = s.withColumn("n1", F.row_number().over(Window.partitionBy("hub", "cell").orderBy("row")))
    return s.join(F.broadcast(n0), ["hub", "cell"]).withColumn("nth", F.col("n0") + F.col("n1") - 1)


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, row (tells rows with one doc_id apart), size, text_crc32, shard and slot."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text).alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hub"),
    )
    base = cut(base.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(shards)).cast("int")))
    sums = base.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, n = sums["b"] or 0, sums["n"]
    hubs = cut(base.groupBy("hub").agg(F.count("*").alias("count"), F.max("size").alias("size")).where("count > 1"))
    many = (F.col("count") * LARGE > F.lit(n)) | (F.col("count") * F.col("size") * LARGE > F.lit(total))
    large = [(r["hub"], r["count"], r["size"]) for r in hubs.where(many).collect()]  # fewer than 2 * LARGE
    ids = [h for h, _, _ in large]
    out = ["doc_id", "row", "size", "text_crc32", "shard", "slot"]
    parts, load, before = [], [0] * shards, [0] * shards
    if large:
        own = base.where(F.col("hub").isin(ids))
        held = {(r["hub"], r["shard"]): r["b"] for r in own.groupBy("hub", "shard").agg(F.sum("size").alias("b")).collect()}
        parts, load, before = pack(large, held, shards, total)
    small = base.where(~F.col("hub").isin(ids)) if large else base
    cells = shards << CELL_BITS
    parts_of = F.when(F.col("count") * cells > n, 1 + F.floor(F.col("count") * cells / max(n, 1))).otherwise(0).cast("int")
    linked = hubs.where(~many).select("hub", F.lit(True).alias("linked"), parts_of.alias("parts"))
    state = small.join(apart(linked, "hub"), "hub", "left")
    state = state.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("parts", F.coalesce("parts", F.lit(0)))
    room = free_room(load, total - sum(load))
    laid = even_cut(propagate(state, shards, total, rounds, load), shards, room, before).select(*out)
    if not large:
        return laid
    where = docs.sparkSession.createDataFrame(parts, "hub long, to int, begin long, end long, slot0 long")
    own = numbered(own.drop("shard"), {h: c for h, c, _ in large}, n).join(F.broadcast(where), "hub").where("nth >= begin AND nth < end")
    own = own.withColumn("shard", F.col("to")).withColumn("slot", F.col("slot0") + F.col("nth") - F.col("begin"))
    return laid.unionByName(own.select(*out))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard, which replace columns of
    these names; every other column is kept.

    Needs text and doc_id only for placement, so the texts themselves aren't moved by the query
    ``sharding_query``; here they are joined back by row, equal rows in any order.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    left = docs.select(F.struct("*").alias("doc"), key.alias("row"))
    left = left.withColumn("copy", F.row_number().over(Window.partitionBy("row").orderBy(F.lit(1))))
    placed = assign(docs, shards, rounds).select("row", "size", "text_crc32", "shard", "slot")
    placed = placed.withColumn("copy", F.row_number().over(Window.partitionBy("row").orderBy("shard", "slot")))
    taken = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    keep = [F.col("doc")[c].alias(c) for c in docs.columns if c not in taken]
    return left.join(placed, ["row", "copy"]).select(*keep, *_result_columns())


def _result_columns() -> list[Column]:
    return [
        F.col("size"),
        F.col("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    ]


def sharding_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    return assign(docs).select("doc_id", *_result_columns())
