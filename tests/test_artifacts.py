"""Cluster artifacts, output sets, seen ids and paged sources as round trips."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.sources import artifacts as A

RECORDS = "idx long, id string, text string, cluster_id long, sim_to_centroid double, dist_to_centroid double, rank_in_cluster long"


@pytest.fixture
def records(spark):
    rows = [(i, f"d{i}", None if i == 3 else f"text {i}", i % 3, 1 - i / 100, i / 100, i // 3) for i in range(10)]
    return spark.createDataFrame(rows, RECORDS)


def test_artifacts_round_trip(spark, records, tmp_path):
    centroids = spark.createDataFrame([(c, n, [float(c), 0.5]) for c, n in [(0, 4), (1, 3), (2, 3), (3, 0)]], "cluster_id long, size long, centroid array<double>")
    A.write_artifacts(records, centroids, str(tmp_path), {"top_k": 5})
    got = A.read_artifacts(spark, str(tmp_path))
    assert sorted(got["records"].collect()) == sorted(records.collect())
    assert sorted(got["centroids"].collect()) == sorted(centroids.collect())
    assert [tuple(r) for r in got["summary"].orderBy(F.col("size").desc(), "cluster_id").collect()] == [(0, 4), (1, 3), (2, 3)]
    assert got["meta"] == {"N": 10, "D": 2, "top_k": 5}
    few = A.read_artifacts(spark, str(tmp_path), ["idx", "cluster_id"])["records"]
    assert few.columns == ["idx", "cluster_id"]
    assert "text" not in few._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="cluster_id"):
        A.write_artifacts(records.drop("cluster_id"), centroids, str(tmp_path))


def test_artifacts_with_arrays_are_read(spark, records, tmp_path):
    pdf = records.toPandas()
    pdf[:6].to_parquet(tmp_path / "records_000000000_000000006.parquet")
    pdf[6:].to_parquet(tmp_path / "records_000000006_000000010.parquet")
    np.save(tmp_path / "centroids.npy", np.eye(3, 4, dtype=np.float32))
    np.savez_compressed(tmp_path / "arrays.npz", membership=pdf["cluster_id"].to_numpy(np.int32), sizes=np.array([4, 3, 3]))
    got = A.read_artifacts(spark, str(tmp_path))
    assert got["records"].count() == 10 and got["summary"] is None and got["meta"] is None
    assert {r.cluster_id: r.centroid for r in got["centroids"].collect()}[1] == [0.0, 1.0, 0.0, 0.0]
    membership = A.read_array(spark, str(tmp_path / "arrays.npz"), "long", "membership")
    assert A.membership_mismatches(got["records"], membership).isEmpty()
    other = membership.withColumn("value", F.when(F.col("idx") == 4, 9).otherwise(F.col("value"))).where("idx <> 7")
    assert sorted(r.idx for r in A.membership_mismatches(got["records"], other).collect()) == [4, 7]


def test_arrays_in_blocks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(3_000_000, dtype=np.float32))
    got = A.read_array(spark, str(tmp_path / "a.npy"))
    assert got.agg(F.count("*"), F.sum("idx"), F.sum(F.abs(F.col("idx") - F.col("value")))).first()[:] == (3_000_000, sum(range(3_000_000)), 0.0)
    np.save(tmp_path / "e.npy", np.zeros((0, 4)))
    assert A.read_array(spark, str(tmp_path / "e.npy"), "array<double>").isEmpty()
    with pytest.raises(Exception, match="dimensions"):
        A.read_array(spark, str(tmp_path / "a.npy"), "array<double>").collect()


def outputs(spark):
    nested = spark.createDataFrame([(1, [("x", 0.5)], 'say "hi",\nthere')], "id long, hits array<struct<doc: string, score: double>>, note string")
    return {name: nested for name in A.RETRIEVAL_SET} | {"chunks_csv": nested.where("id > 1")}


def test_output_sets(spark, tmp_path):
    path = str(tmp_path / "set")
    assert not A.set_readable(spark, A.RETRIEVAL_SET, path)
    A.write_set(outputs(spark), A.RETRIEVAL_SET, path)
    assert A.set_readable(spark, A.RETRIEVAL_SET, path)
    with pytest.raises(ValueError, match="set is"):
        A.write_set({"summary_csv": outputs(spark)["summary_csv"]}, A.RETRIEVAL_SET, path)
    part = next((tmp_path / "set" / "packets_jsonl").glob("part-*.json"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_text('{"id": 1, "hits": [')
    assert not A.set_readable(spark, A.RETRIEVAL_SET, path)
    A.write_set(outputs(spark), A.RETRIEVAL_SET, path)
    (tmp_path / "set" / "evidence_csv" / "_SUCCESS").unlink()
    assert not A.set_readable(spark, A.RETRIEVAL_SET, path)


def test_seen_ids(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert A.seen_ids(spark, path).isEmpty()
    for batch in (["a", "b", "b", None], ["b", "c"], []):
        A.add_seen(spark.createDataFrame([(x,) for x in batch], "id string"), path)
        assert A.seen_ids(spark, path).count() == A.seen_ids(spark, path).distinct().count()
    assert sorted(r.id for r in A.seen_ids(spark, path).collect()) == ["a", "b", "c"]
    (tmp_path / "seen.json").write_text(json.dumps(["z", "y", "z"], indent=2))
    assert sorted(r.id for r in A.seen_ids(spark, str(tmp_path / "seen.json")).collect()) == ["y", "z"]


@pytest.mark.parametrize(
    "seen, limit, want, asked",
    [
        (["i4"], 200, ["i0", "i1", "i2", "i3"], [1, 2]), ([], 200, [f"i{k}" for k in range(7)], [1, 2, 3]), (["i0"], 200, [], [1]),
        ([], 4, ["i0", "i1", "i2", "i3"], [1, 2]), (["other"], 0, [], []),
    ],
)
def test_pages_until_the_first_seen(spark, seen, limit, want, asked):
    items = [{"id": f"i{k}", "title": f"t{k}", "more": k} for k in range(7)]
    called, paused = [], []

    def page(number):
        called.append(number)
        return [{"id": None}, *items[(number - 1) * 3 : number * 3]], 3

    known = spark.createDataFrame([(x,) for x in seen], "id string")
    got = A.new_since_seen(spark, page, known, "id string, title string", limit, pause=lambda: paused.append(1))
    assert [r.id for r in got.collect()] == want and got.columns == ["id", "title"]
    assert called == asked and len(paused) == max(0, len(asked) - 1)
