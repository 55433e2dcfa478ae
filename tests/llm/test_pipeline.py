import hashlib
from collections import Counter

import corpus_pipeline
from spindrift.llm import decontaminate, jaccard_join, quality_rules, source_mixing


def test_stages_on_a_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "decontaminate", "source_mixing", "sharding"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    kept = {r["doc_id"] for r in quality_rules.quality_query(docs).where("kept").collect()}
    assert ids[1] == sorted(kept)
    rows = frames[1].orderBy("doc_id").collect()
    first = {c for c, _ in jaccard_join.brute_force([r["text"] for r in rows])}
    assert ids[2] == [r["doc_id"] for k, r in enumerate(rows) if k in first]
    bad = {r["doc_id"] for r in decontaminate.contamination(frames[2], bench).where("contaminated").collect()}
    assert ids[3] == [i for i in ids[2] if i not in bad]
    taken = Counter({r["doc_id"]: r["copies"] for r in source_mixing.mix(frames[3]).collect()})
    assert Counter(ids[4]) == +taken
    assert ids[5] == ids[4]
    text = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 for r in frames[5].collect())


def test_run_is_the_stages(spark, sf_dir):
    a, b = (corpus_pipeline.run(spark, sf_dir).toPandas() for _ in range(2))
    digest = lambda x: hashlib.sha256(x.sort_values(["shard", "slot"]).to_csv().encode()).hexdigest()
    assert digest(a) == digest(b) and len(a)
    assert a.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s)))).all()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, edge, edge_rows, tmp_path):
    """Nulls, ties, repeated rows and clashing names pass through every stage alone."""
    spark.createDataFrame([(1, "some words of a benchmark"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, str(tmp_path))
        assert name == "sharding" or out.columns == edge.columns
        counts[name] = out.count()
    assert 0 < counts["quality_rules"] < len(edge_rows)
    assert counts["jaccard_join"] == len({c for c, _ in jaccard_join.brute_force([r[1] for r in edge_rows])})
    assert counts["decontaminate"] == counts["sharding"] == len(edge_rows)
    assert counts["source_mixing"] > 0
