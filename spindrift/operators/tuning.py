"""Parameters of neighbour search and clustering by the number of items."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Share(NamedTuple):
    """A share of the neighbour count, rounded, then held between a least and a most value."""

    share: float
    rounding: str = "ceil"
    least: int = 0
    most: int | None = None


class Range(NamedTuple):
    """The parameters of all corpora with fewer than ``below`` items (None: of all others)."""

    below: int | None
    mode: str
    low_top: tuple[int, float]  # at least, share of the items
    high_top: int  # at most
    low: Mapping[str, Share]
    high: Mapping[str, Share]
    ef_search_twice: bool  # the high side searches twice the neighbours, else all items
    q_sim: tuple[int, int]
    use_mutual: bool
    resolutions: tuple[tuple[float, ...], tuple[float, ...]]


# The four ranges of corpus sizes with the low and the high side of every parameter.
RANGES = (
    Range(
        200, "precise", (0, 0.6), 256,
        {"max_edges_per_node": Share(0.25, least=8), "attach_neigh_k": Share(0.10, least=8), "pair_k": Share(0.50, least=16), "ef_construction": Share(1.0)},
        {"max_edges_per_node": Share(1.0, most=64), "attach_neigh_k": Share(1.0, most=32), "pair_k": Share(1.0), "ef_construction": Share(4.0, least=64)},
        True, (75, 90), False, ((0.8, 1.0, 1.2), (1.0, 1.2, 1.4)),
    ),
    Range(
        1500, "precise", (128, 0.5), 2048,
        {"max_edges_per_node": Share(0.15, least=16), "attach_neigh_k": Share(0.08, least=16), "pair_k": Share(0.20, least=32), "ef_construction": Share(0.0, least=128)},
        {"max_edges_per_node": Share(1.0, most=256), "attach_neigh_k": Share(1.0, most=128), "pair_k": Share(1.0, most=512), "ef_construction": Share(0.40, "even", 128, 512)},
        False, (80, 92), False, ((1.0, 1.2, 1.4), (1.2, 1.5, 1.8)),
    ),
    Range(
        10000, "precise", (1024, 0.4), 6144,
        {"max_edges_per_node": Share(0.10, least=64), "attach_neigh_k": Share(0.05, least=32), "pair_k": Share(0.15, least=128), "ef_construction": Share(0.10, least=128)},
        {"max_edges_per_node": Share(0.30, "even", 0, 1024), "attach_neigh_k": Share(0.15, "even", 0, 512), "pair_k": Share(0.35, "floor", 0, 2048), "ef_construction": Share(0.50, "even", 0, 2048)},
        False, (88, 95), True, ((1.2, 1.5, 1.8), (1.6, 2.0, 2.4)),
    ),
    Range(
        None, "medium", (2048, 0.12), 8192,
        {"max_edges_per_node": Share(0.08, least=256), "attach_neigh_k": Share(0.03, least=64), "pair_k": Share(0.12, least=512), "ef_construction": Share(0.04, least=128)},
        {"max_edges_per_node": Share(0.25, most=1024), "attach_neigh_k": Share(0.12, most=512), "pair_k": Share(0.30, most=2048), "ef_construction": Share(0.15, most=512)},
        True, (88, 95), True, ((1.6, 1.8, 2.0), (1.8, 2.2, 2.6)),
    ),
)

ROUNDINGS = {"ceil": F.ceil, "floor": F.floor, "even": F.rint}


def _between(x: Column, least: Column | int, most: Column | int) -> Column:
    """``x`` held between two bounds; the lower one wins where they cross."""
    bound = lambda b: b if isinstance(b, Column) else F.lit(b)
    return F.greatest(bound(least), F.least(x, bound(most)))


def _whole(x: Column) -> Column:
    return x.cast("long")


def _side(r: Range, n: Column, high: bool) -> Column:
    """One side of a range as a struct; neighbour counts in it aren't yet put in order."""
    least, share = r.low_top
    top = F.least(n - 1, F.lit(r.high_top)) if high else F.greatest(F.lit(least), _whole(F.ceil(F.lit(share) * n)))
    parts = {}
    for name, s in (r.high if high else r.low).items():
        x = F.greatest(F.lit(s.least), _whole(ROUNDINGS[s.rounding](F.lit(s.share) * top)))
        parts[name] = F.least(x, F.lit(s.most)) if s.most is not None else x
    search = (2 * top if r.ef_search_twice else n - 1) if high else top
    return F.struct(
        _whole(_between(top, 2, n - 1)).alias("top_k"), *(_whole(c).alias(k) for k, c in parts.items()), _whole(search).alias("ef_search"),
        F.lit(r.q_sim[high]).alias("q_sim"), F.lit(r.use_mutual).alias("use_mutual"),
        F.array(*(F.lit(x) for x in r.resolutions[high])).alias("resolutions"),
    )


def recommended(n: Column, side: str = "max") -> Column:
    """Struct of the parameters for ``n`` items on one side, ``min`` or ``max``, of their ranges.

    Neighbour counts lie in 2 … n - 1, the low one never above the high one; edges, attachments and
    pairs below the neighbour count, search breadth from it to n - 1.  Two items or fewer get the
    least legal values.
    """
    if side not in ("min", "max"):
        raise ValueError(f"side must be min or max, got {side}")
    n = n.cast("long")
    none = F.lit(None)
    low = high = mode = None
    for r in reversed(RANGES):
        a, b, m = _side(r, n, False), _side(r, n, True), F.lit(r.mode)
        if r.below is None:
            low, high, mode = a, b, m
        else:
            low, high, mode = (F.when(n < r.below, x).otherwise(y) for x, y in ((a, low), (b, high), (m, mode)))
    pick = high if side == "max" else low
    top = (F.greatest if side == "max" else F.least)(low["top_k"], high["top_k"])
    below_top = lambda name: _between(pick[name], 1, F.greatest(F.lit(1), top - 1))
    tiny = n <= 2
    small = {"top_k": F.greatest(F.lit(1), n - 1), "max_edges_per_node": 1, "attach_neigh_k": 1, "pair_k": 1, "ef_search": F.greatest(F.lit(1), n - 1), "ef_construction": 2}
    full = {
        "top_k": top, **{k: below_top(k) for k in ("max_edges_per_node", "attach_neigh_k", "pair_k")},
        "ef_search": F.greatest(top, F.least(pick["ef_search"], n - 1)), "ef_construction": _between(pick["ef_construction"], 1, n - 1),
    }
    whole = [_whole(F.when(tiny, small[k]).otherwise(full[k])).alias(k) for k in full]
    return F.when(n.isNull(), none).otherwise(
        F.struct(
            *whole, pick["q_sim"].alias("q_sim"), (pick["use_mutual"] & ~tiny).alias("use_mutual"),
            F.when(tiny, F.array(F.lit(1.0))).otherwise(pick["resolutions"]).alias("resolutions"), F.when(tiny, "precise").otherwise(mode).alias("mode"),
        )
    )


def fitted(config: Mapping[str, object], n: int) -> dict[str, object]:
    """A configuration made legal for ``n`` items; a corpus larger than its counts leaves it as it is."""
    top = max(1, min(int(config["top_k"]), n))
    out = dict(config) | {"top_k": top}
    for name in ("max_edges_per_node", "attach_neigh_k", "pair_k"):
        out[name] = min(int(config[name]), max(1, top - 1))
    if n <= 1:
        return out | {"ef_search": 1, "ef_construction": 2, "use_mutual": False}
    out["ef_search"] = min(max(int(config["ef_search"]), top), 4 * top)
    out["ef_construction"] = max(2, min(int(config["ef_construction"]), n - 1))
    out["use_mutual"] = bool(config["use_mutual"]) and n > 2
    return out
