"""Sampler epochs and the best checkpoints across sessions."""

import json

import pytest

from spindrift.operators.state import BestCheckpoints, EpochSampler
from spindrift.sources import atomic


@pytest.fixture
def pool(spark):
    return spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(4)], "source string, item int")


def sampler(pool, path, **kw):
    return EpochSampler(pool, "source", "item", [{"a": 7, "b": 3}, {"a": 6, "b": 4}, {"a": 5, "b": 5}], "7", str(path), **kw)


def drawn(df):
    return sorted((r.source, r.item, r.level) for r in df.collect())


def test_epochs_replay_and_go_on(pool, tmp_path):
    straight = sampler(pool, tmp_path / "x")
    want = [drawn(straight.draw()) for _ in range(4)]
    assert [(sum(r[0] == "a" for r in e), sum(r[0] == "b" for r in e)) for e in want] == [(7, 3), (6, 4), (5, 5), (5, 5)]
    usage = [r.usage for r in straight.usage().collect()]
    assert len(usage) == 11 and sum(usage) == 40
    for source in "ab":
        of = [r.usage for r in straight.usage().collect() if r.source == source]
        assert max(of) - min(of) <= 1
    broken = sampler(pool, tmp_path / "y")
    assert [drawn(broken.draw()) for _ in range(2)] == want[:2]
    again = sampler(pool, tmp_path / "y", replay=True)
    assert [drawn(again.draw()) for _ in range(3)] == want[1:4]
    assert drawn(sampler(pool, tmp_path / "x").draw()) == drawn(straight.draw())


def test_an_epoch_that_was_cut_off_is_drawn_again(pool, tmp_path):
    first = sampler(pool, tmp_path)
    want = [drawn(first.draw()), drawn(first.draw())]
    state = json.loads((tmp_path / "state.json").read_text())
    (tmp_path / "state.json").write_text(json.dumps(state | {"epoch": 1}))
    (tmp_path / ".state.json.crc").unlink(missing_ok=True)
    assert drawn(sampler(pool, tmp_path).draw()) == want[1]


def test_another_sampler_is_refused(pool, tmp_path, spark):
    sampler(pool, tmp_path).draw()
    with pytest.raises(ValueError, match="sizes"):
        sampler(pool.where("item < 3"), tmp_path)
    with pytest.raises(ValueError, match="seed"):
        EpochSampler(pool, "source", "item", [{"a": 7, "b": 3}, {"a": 6, "b": 4}, {"a": 5, "b": 5}], "8", str(tmp_path))


def test_best_checkpoints(spark, tmp_path):
    path = str(tmp_path / "best.json")
    best = BestCheckpoints(spark, path, "score", 2)
    assert best.offer(1, 0.5, "c1") == [] and best.offer(2, 0.7, "c2") == []
    assert [r["step"] for r in best.offer(3, 0.6, "c3")] == [1]
    assert [r["step"] for r in best.offer(4, float("nan"), "c4")] == [4]
    resumed = BestCheckpoints(spark, path, "score", 2, resume=True)
    assert resumed.records == best.records and [r["step"] for r in resumed.records] == [2, 3]
    assert [r["step"] for r in resumed.offer(5, 0.9, "c5")] == [3]
    assert [r["step"] for r in resumed.offer(6, 0.9, "c6")] == [2] and [r["step"] for r in resumed.records] == [5, 6]
    assert [r["step"] for r in resumed.offer(7, 0.9, "c7")] == [7]
    least = BestCheckpoints(spark, str(tmp_path / "least.json"), "loss", 1, greater_is_better=False)
    least.offer(1, 2.0, "a")
    assert [r["step"] for r in least.offer(2, 1.0, "b")] == [1]


@pytest.mark.parametrize(
    "change, match",
    [
        ({"metric_name": "loss"}, "other settings"), ({"top_k": 3}, "other settings"), ({"best_records": None}, "list"),
        ({"best_records": [{"step": 1}]}, "whole"), ({"best_records": [{"step": 1, "metric": "inf", "path": "x"}]}, "finite"),
        ({"best_records": [{"step": 1, "metric": 1, "path": "x"}] * 2}, "twice"),
        ({"best_records": [{"step": i, "metric": 1, "path": "x"} for i in range(3)]}, "more than"),
    ],
)
def test_a_manifest_that_does_not_fit_is_refused(spark, tmp_path, change, match):
    path = str(tmp_path / "best.json")
    BestCheckpoints(spark, path, "score", 2).offer(1, 0.5, "c1")
    atomic.replace_json(spark, path, atomic.read_json(spark, path) | change)
    with pytest.raises(ValueError, match=match):
        BestCheckpoints(spark, path, "score", 2, resume=True)


def test_resume_needs_a_manifest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        BestCheckpoints(spark, str(tmp_path / "none.json"), "score", 2, resume=True)
    atomic.replace_text(spark, str(tmp_path / "bad.json"), "{")
    with pytest.raises(ValueError, match="no manifest"):
        BestCheckpoints(spark, str(tmp_path / "bad.json"), "score", 2, resume=True)


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    assert not atomic.exists(spark, path)
    for text in ("one", "zwei é", ""):
        atomic.replace_text(spark, path, text)
        assert atomic.read_text(spark, path) == text
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]
