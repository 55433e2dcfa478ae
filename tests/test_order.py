"""Running sums over ranges, and curation from end to end."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import curate as C
from spindrift.operators import relational as R
from spindrift.operators.order import numbered, running


def test_running_sums_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.randint(-5, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "i int, g int, n long").repartition(13)
    got = {r.i: (r.at, r.upto) for r in running(d, [F.col("g").desc_nulls_last(), "i"], {"at": F.lit(1), "upto": "n"}).collect()}
    total = 0
    for k, (i, _, n) in enumerate(sorted(rows, key=lambda r: (-(r[1] or 0), r[0]))):
        total += n
        assert got[i] == (k + 1, total)
    assert sorted(r.p for r in numbered(d, ["i"], "p").collect()) == list(range(500))
    assert numbered(d.where("i < 0"), ["i"], "p", 1).isEmpty()


def test_a_page_beyond_the_last_is_empty(spark):
    d = spark.range(7)
    assert [(r.id, r.total) for r in R.page(d, [F.col("id").desc()], 2, 3).collect()] == [(3, 7), (2, 7), (1, 7)]
    assert R.page(d, [F.col("id")], 4, 3).isEmpty() and R.page(d.where("id > 9"), [F.col("id")], 1, 3).isEmpty()


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(45):
        v = np.eye(8)[i % 3] + rng.normal(0, 0.05, 8)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], f"text {i}", [["a", "b", "c"][i % 3]] if i < 43 else ["rare"]))
    return spark.createDataFrame(rows, "id long, v array<double>, text string, labels array<string>")


def test_curation_from_end_to_end(spark, planted, tmp_path):
    got = C.curate(planted, "id", "v", "text", 8, 9, 10, str(tmp_path)).collect()
    assert len(got) == 9 and len({r.id for r in got}) == 9
    by = {}
    for r in got:
        by.setdefault(r.cluster, set()).add(r.id % 3)
    assert all(len(g) == 1 for g in by.values()) and {g for s in by.values() for g in s} == {0, 1, 2}
    again = C.curate(planted, "id", "v", "text", 8, 9, 10, str(tmp_path))  # from the artifacts
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in got)
    assert C.clustered(planted.where("id = 4"), "id", "v").collect()[0][:] == (4, 4)


def test_curation_by_label_keeps_protected_items(planted, tmp_path):
    got = C.curate_by_label(planted, "id", "v", "text", "labels", 8, 3, 0.4, 10, str(tmp_path), only=["rare", "a"]).collect()
    assert sorted(r.id for r in got if r.protected) == [43, 44]
    own = [r for r in got if not r.protected]
    assert {r.primary_label for r in own} == {"a"} and len(own) == 6
