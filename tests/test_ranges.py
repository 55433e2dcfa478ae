"""As-of and interval joins against brute force, parameters by corpus size, checked claim jobs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import ranges as G
from spindrift.operators import retrieval as Q
from spindrift.operators import tuning


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_equals_brute_force(spark, width):
    rng = random.Random(width)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(-20, 60)])) for i in range(120)]
    right = [(i, rng.choice(["a", "b", "c"]), rng.randint(-20, 60), float(i)) for i in range(90)]
    got = G.as_of(
        spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "o int, k string, t long, v double"), ["k"], "t", "v", width, "o"
    )
    want = {}
    for i, k, t in left:
        found = max(((rt, o, v) for o, rk, rt, v in right if k is not None and t is not None and rk == k and rt <= t), default=None)
        want[i] = (found and found[2], found and found[0])
    rows = got.collect()
    assert len(rows) == len(left) and {r.id: (r.v, r.v_at) for r in rows} == want


@pytest.mark.parametrize("width", [1, 5, 400])
def test_intervals_equal_brute_force(spark, width):
    rng = random.Random(width)
    points = [(i, rng.choice("ab"), rng.choice([None, *range(-10, 50)])) for i in range(80)]
    spans = [(i, rng.choice("ab"), a := rng.randint(-10, 40), a + rng.randint(-2, 15)) for i in range(60)]
    got = G.in_intervals(
        spark.createDataFrame(points, "p int, k string, t long"), spark.createDataFrame(spans, "s int, k string, a long, b long"), ["k"], "t", "a", "b", width
    )
    want = sorted((p, s) for p, k, t in points for s, sk, a, b in spans if t is not None and k == sk and a <= t < b)
    assert sorted((r.p, r.s) for r in got.collect()) == want


def parameters(spark, n, side):
    return spark.range(1).select(tuning.recommended(F.lit(n), side).alias("p")).first()["p"].asDict()


def test_parameters_by_size(spark):
    low, high = parameters(spark, 100, "min"), parameters(spark, 100, "max")
    assert (low["top_k"], low["max_edges_per_node"], low["attach_neigh_k"], low["pair_k"], low["ef_search"], low["ef_construction"]) == (60, 15, 8, 30, 60, 60)
    assert (high["top_k"], high["max_edges_per_node"], high["attach_neigh_k"], high["pair_k"], high["ef_search"], high["ef_construction"]) == (99, 64, 32, 98, 99, 99)
    assert (low["q_sim"], high["q_sim"], high["use_mutual"], high["resolutions"]) == (75, 90, False, [1.0, 1.2, 1.4])
    mid = parameters(spark, 5000, "max")
    assert (mid["top_k"], mid["max_edges_per_node"], mid["attach_neigh_k"], mid["pair_k"], mid["ef_search"], mid["ef_construction"]) == (4999, 1024, 512, 1749, 4999, 2048)
    large, small = parameters(spark, 1_000_000, "max"), parameters(spark, 1_000_000, "min")
    assert (small["top_k"], large["top_k"], large["mode"], large["use_mutual"]) == (8192, 120_000, "medium", True)  # the sides cross and are put in order
    assert parameters(spark, 1755, "max")["max_edges_per_node"] == round(0.3 * 1754)
    assert parameters(spark, 1756, "max")["max_edges_per_node"] == round(0.3 * 1755)  # 526.5 goes to the even one


def test_parameters_are_legal_at_every_size(spark):
    n = spark.range(0, 30_000, 7).unionAll(spark.range(0, 250))
    for side in ("min", "max"):
        p = n.select("id", tuning.recommended(F.col("id"), side).alias("p")).select("id", "p.*")
        bad = p.where("top_k < 1 OR (id > 2 AND top_k > id - 1) OR max_edges_per_node < 1 OR attach_neigh_k < 1 OR pair_k < 1 OR ef_search < top_k")
        over = p.where("id > 2 AND (max_edges_per_node > greatest(1, top_k - 1) OR pair_k > greatest(1, top_k - 1) OR ef_search > id - 1 OR ef_construction > id - 1)")
        assert bad.isEmpty() and over.isEmpty()
    assert spark.range(1).select(tuning.recommended(F.lit(None).cast("long")).alias("p")).first()["p"] is None
    with pytest.raises(ValueError, match="min or max"):
        tuning.recommended(F.lit(1), "mid")


def test_configuration_fitted_to_a_size():
    config = {"top_k": 512, "max_edges_per_node": 128, "attach_neigh_k": 64, "pair_k": 256, "ef_search": 600, "ef_construction": 256, "use_mutual": True}
    assert tuning.fitted(config, 300_000) == config
    small = tuning.fitted(config, 10)
    assert (small["top_k"], small["max_edges_per_node"], small["attach_neigh_k"], small["pair_k"]) == (10, 9, 9, 9)
    one = tuning.fitted(config, 1)
    assert (one["top_k"], one["ef_search"], one["ef_construction"], one["use_mutual"]) == (1, 1, 2, False)


def test_failed_jobs_stay_rows(spark):
    rows = [(1, "a claim", [1.0, 0.0]), (2, "  ", [1.0, 0.0]), (3, "b", None), (4, "c", [1.0]), (5, "d", [1.0, math.nan]), (6, None, None), (7, "e", [1.0, None])]
    got = Q.checked_jobs(spark.createDataFrame(rows, "i int, claim string, v array<double>"), "claim", "v", 2)
    assert {r.i: r.error for r in got.collect()} == {
        1: None, 2: "empty claim", 3: "no vector", 4: "vector of 1 for 2", 5: "vector not finite", 6: "empty claim", 7: "vector not finite"
    }
