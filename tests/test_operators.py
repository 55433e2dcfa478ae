"""Operators on literal rows, semantics traps included."""

import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.functions import parsing as P2
from spindrift.functions import scalars as S
from spindrift.functions import text as T
from spindrift.operators import blocks
from spindrift.operators import features as X
from spindrift.operators import relational as R
from spindrift.operators import retrieval as Q
from spindrift.operators import sampling as P
from spindrift.operators import vectors as V
from spindrift.plans.catalog import QUERIES
from spindrift.sources import files
from spindrift.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_highlight_cleaning(spark):
    assert one(spark, T.clean_highlights(F.lit("  VIDEO  NEW: First line.\n\nSecond   line. "))) == "First line. Second line."
    assert one(spark, T.clean_highlights(F.lit("Watching it"))) == "ing it"
    assert one(spark, T.clean_highlights(F.lit(None).cast("string"))) == ""


def test_word_slice(spark):
    text = F.lit(" ".join(f"w{k}" for k in range(1, 11)))
    assert one(spark, T.word_slice(text, 3, 6)) == "w3 w4 w5 w6"
    assert one(spark, T.word_slice(text, 9, 0)) == "w9 w10"
    assert one(spark, T.word_slice(text, 20, 0)) == "" and one(spark, T.word_slice(F.lit(""), 1, 3)) == ""


@pytest.mark.parametrize(
    ("mode", "tail"), [("final_only", [10, 20, -100, 100]), ("none", [10, 20, -100, -100]), ("all", [10, 20, 99, 100])]
)
def test_answer_labels(spark, mode, tail):
    ids = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, S.answer_labels(ids(1, 2), ids(10, 20, 99, 100), [[99], [100]], mode)) == [-100, -100, *tail]


def test_schedule(spark):
    got = [one(spark, S.binned_schedule(F.lit(p), 0.04, 0.01, 0.0, 0.8, 0.01)) for p in (0.0, 0.4, 0.8)]
    assert got == pytest.approx([0.04, 0.04 - 0.03 * 50 / 99, 0.01])


def test_idf_is_at_least_one(spark):
    assert one(spark, S.idf_weight(F.lit(10), F.lit(9), 0.15, 2)) == 1.0
    assert one(spark, S.idf_weight(F.lit(10**6), F.lit(1), 0.5, 2)) == 2.0


def test_hashes(spark):
    assert one(spark, S.object_uuid(F.lit("a"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a"))
    assert 0 <= one(spark, S.stable_unit(F.lit("k"))) < 1
    assert one(spark, S.canonical_json(b=F.lit('q"'), a=F.lit(None).cast("string"))) == '{"a":null,"b":"q\\""}'


def test_keywords_keep_the_first_spelling(spark):
    assert one(spark, T.split_keywords(F.lit("Oil, oil;Gas|  GAS ,x"))) == ["Oil", "Gas", "x"]
    assert one(spark, T.normalize_keyword_field(F.lit('["a"," b "]'))) == ["a", "b"]
    assert one(spark, T.normalize_keyword_field(F.lit('{a,"b"}'))) == ["a", "b"]


def test_sentences_and_spans(spark):
    text = "Dr one two three. Four five six!\nSeven eight. Nine ten eleven twelve?"
    s = one(spark, T.article_sentences(F.lit(text)))
    assert s == ["Dr one two three.", "Four five six!", "Nine ten eleven twelve?"]
    spans = one(spark, Q.char_spans(F.lit(text), F.array(*map(F.lit, [*s, "Four five six!"]))))
    assert [text[a:b] for a, b in spans[:3]] == s and tuple(spans[3]) == (-1, -1)


def test_final_answers(spark):
    shapes = {
        " <|end|>": ("", False, "empty_output"),
        "<think>cut": ("", False, "unclosed_think_block_likely_truncated"),
        "<THINK>a</think> ": ("", False, "empty_after_removing_think"),
        "the correct answer is: x y": ("x y", True, "prefix_at_start"),
        "so The correct answer is: z": ("z", True, "prefix_found_later"),
        "Highlight: q": ("Highlight: q", True, "missing_prefix_but_starts_with_highlight"),
        "other": ("", False, "missing_required_prefix"),
    }
    for t, want in shapes.items():
        assert tuple(one(spark, P2.final_answer(F.lit(t)))) == want, t


def test_verdicts(spark):
    got = [one(spark, P2.first_round(F.lit(x))) for x in ("PASS, not verify", "pass notverify", "xPASSx", "", "`Pass`")]
    assert got == ["VERIFY", "PASS", "PASS", "VERIFY", "PASS"]
    got = one(spark, P2.combined_answer(F.lit("The correct category is: 'a'\nThe correct keywords are: k ; l"), ["a"]))
    assert tuple(got) == ("a", "k, l", True, "category=prefix_line; keywords=prefix_line")
    assert one(spark, P2.labels_of_answer(F.lit("[categories] a | big special12,a [/CATEGORIES]"))) == ["a", "big special"]


def test_minute_markers_and_wide_spaces(spark):
    s = one(spark, T.article_sentences(F.lit("One two three 45+3 mins: four five six. 90 min +2 seven\u3000eight\u00a0nine")))
    assert s == ["One two three", "45+3 mins: four five six.", "90 min +2 seven eight nine"]
    assert one(spark, T.minute_marker(F.lit(" 45+3 mins: x"))) == "45+3 mins:"
    assert one(spark, T.claim_sentences(F.lit("highlight: A b\nc. D!"))) == ["A b\nc.", "D!"]


def test_empty_scope_is_not_unscoped(spark):
    df = spark.range(3)
    assert R.scoped(df, "id", []).count() == 0 and R.scoped(df, "id", None).count() == 3
    assert R.scoped(df, "id", [0, 1], [1]).count() == 1


def test_conditional_upsert_ignores_other_columns(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 1)], "k int, v string, f int")
    b = spark.createDataFrame([(1, "a", 9), (2, "x", 9), (4, "d", 9)], "k int, v string, f int")
    got = {r["k"]: (r["action"], r["v"], r["f"]) for r in R.conditional_upsert(t, b, "k", ["v"]).collect()}
    assert got == {1: ("unchanged", "a", 1), 2: ("update", "x", 9), 3: ("keep", "c", 1), 4: ("insert", "d", 9)}


def test_state_join_leaves_repeated_left_keys_alone(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, l string")
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (4, 4), (4, 5)], "k int, r int")
    got = sorted(((r["k"], r["l"], r["r"]) for r in R.assemble_states(a, b, "k", ["l"], ["r"]).collect()), key=str)
    assert got == sorted([(1, "a", 2), (2, "b", None), (2, "c", None), (2, None, 3), (4, None, 4), (4, None, 5)], key=str)


def test_one_to_one_join_refuses_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="left"):
        R.one_to_one_left(a, b, ["k"])


def test_gap_representatives_prefer_the_farther_of_equal_gaps(spark):
    rows = [(k, "c", float(x), k, 6) for k, x in enumerate([0.0, 0.1, 0.2, 0.3, 0.4, 0.5])]
    df = spark.createDataFrame(rows, "id int, cl string, dist double, rank long, size long")
    pick = lambda n: sorted(r["id"] for r in V.gap_representatives(df, "id", "cl", F.lit(n)).collect())
    assert pick(1) == [0] and pick(2) == [0, 5] and pick(3) == [0, 4, 5] and pick(9) == list(range(6))


def test_knn_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {(r["src"], r["rank"]): r["dst"] for r in V.knn(df, df, "id", "v", 4).collect()}
    sims = np.round(x @ x.T, 12)
    np.fill_diagonal(sims, -np.inf)
    for k in range(30):
        assert [got[k, r] for r in range(1, 5)] == np.argsort(-sims[k], kind="stable")[:4].tolist()


def test_knn_sends_k_rows_a_query():
    """However many blocks of the base a task meets, and with copies, near ties and numbers of any size."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6))
    x[100:180] = x[5]
    x[180:220] = x[6] * (1 + 1e-9 * np.arange(40))[:, None]
    for y in (x, x * 1e17, x.astype(np.float32).astype(float)):
        ids = rng.permutation(300)
        pack = lambda i, p: dict(zip([f"{p}{c}" for c in ("b", "i", "m", "wide")], [0, ids[i].tobytes(), *blocks.vector_bytes(y[i])], strict=True))
        rows = [pack(np.arange(300), "q") | pack(np.arange(lo, lo + 20), "b") for lo in range(0, 300, 20)]
        for include in (False, True):
            out = pa.Table.from_batches(V._nearest(4, include)(iter(pa.Table.from_pylist(rows).to_batches()))).to_pylist()
            assert len(out) == 4 * 300
            order = np.argsort(ids)
            sims = np.round(y @ y[order].T, 12)
            if not include:
                sims[ids[:, None] == ids[order][None, :]] = -np.inf
            near = np.take_along_axis(sims, np.argsort(-sims, axis=1, kind="stable")[:, :4], 1).ravel()
            assert np.allclose([r["sim"] for r in out], near, rtol=1e-12, atol=1e-12)


def test_approximate_queries_are_not_copied(spark, monkeypatch):
    """A query lies in one block, whatever number of lists it looks into."""
    rng = np.random.default_rng(9)
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((200, 4)))], "id long, v array<double>")
    centres = V.coarse_centres(e, "id", "v", 9)
    asked = V._listed(e, "id", "v", centres, 16, "q", 9).collect()
    assert sorted(np.concatenate([np.frombuffer(r["qi"], np.int64) for r in asked]).tolist()) == list(range(200))
    assert all(r["qlists"] == list(range(9)) for r in asked)
    got = {(r["src"], r["dst"]) for r in V.knn_approximate(e, e, "id", "v", 5, probes=9, lists=9).collect()}
    assert got == {(r["src"], r["dst"]) for r in V.knn(e, e, "id", "v", 5).collect()}


def test_approximate_neighbours_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = lambda df: {(r["src"], r["dst"]) for r in df.collect()}
    exact = pairs(V.knn(e, e, "vec_id", "embedding", 10))
    assert len(exact & pairs(V.knn_approximate(e, e, "vec_id", "embedding", 10))) / len(exact) > 0.9


def test_approximate_neighbours_of_groups(spark):
    """Where vectors lie in groups, few rows are met: far fewer than rows x rows."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((40, 16))
    x = np.repeat(centre, 30, 0) + 0.15 * rng.standard_normal((1200, 16))
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    exact = {(r["src"], r["dst"]) for r in V.knn(e, e, "id", "v", 5).collect()}
    got = V.knn_approximate(e, e, "id", "v", 5)
    assert len(exact & {(r["src"], r["dst"]) for r in got.collect()}) / len(exact) > 0.9
    centres = V.coarse_centres(e, "id", "v", 11)
    held = V.cut(V._in_lists(e, "id", "v", centres, 1))
    assert V._probes_for(e, e, "id", "v", 5, centres, held, 0.95) <= 3


def modularity(edges, label, resolution=1.0):
    total, k, inside = 2 * sum(w for *_, w in edges), {}, 0.0
    for u, v, w in edges:
        inside += 2 * w * (label[u] == label[v])
        for x in (u, v):
            k[label[x]] = k.get(label[x], 0.0) + w
    return inside / total - resolution * sum((x / total) ** 2 for x in k.values())


def test_communities_find_planted_groups(spark):
    """Groups of a planted partition; a higher resolution or the size stop gives smaller clusters."""
    rng = random.Random(6)
    edges = [(a, b, 1.0) for a in range(48) for b in range(a + 1, 48) if rng.random() < (0.7 if a // 12 == b // 12 else 0.04)]
    e = spark.createDataFrame(edges, "u long, v long, weight double")
    nodes = spark.createDataFrame([(k,) for k in range(50)], "node long")
    found = {r["node"]: r["cluster"] for r in V.communities(e, nodes).collect()}
    planted = modularity(edges, {k: k // 12 for k in range(48)})
    assert len(found) == 50 and modularity(edges, found) >= planted - 0.03
    small = V.communities(e, nodes, (0.05, 1.0), largest=20)
    assert small.groupBy("cluster").count().agg({"count": "max"}).first()[0] <= 20


def brute_attach(members, near, threshold):
    size = {}
    for c in members.values():
        size[c] = size.get(c, 0) + 1
    label = dict(members)
    for i in sorted(members):
        if size[members[i]] != 1:
            continue
        for j, s in near[i]:
            if s < threshold:
                break
            if size[label[j]] >= 2:
                label[i] = label[j]
                break
    return label


def test_attach_singletons_is_sequential(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 24
        members = {k: (k if rng.random() < 0.7 else 100 + rng.randint(0, 2)) for k in range(n)}
        near = {k: sorted(((j, round(rng.random(), 3)) for j in rng.sample([x for x in range(n) if x != k], 4)), key=lambda x: -x[1]) for k in range(n)}
        edges = [(k, j, s, r + 1) for k, x in near.items() for r, (j, s) in enumerate(x)]
        m = spark.createDataFrame(list(members.items()), "node long, cluster long")
        e = spark.createDataFrame(edges, "src long, dst long, sim double, rank long")
        got = {r["node"]: r["cluster"] for r in V.attach_singletons(m, e, 0.4).collect()}
        assert got == brute_attach(members, near, 0.4)


def test_communities_stay_inside_components(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (5, 6, 0.9)], "u long, v long, weight double")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "node long")
    comp = {r["node"]: r["component"] for r in V.connected(edges.select("u", "v"), nodes).collect()}
    found = {r["node"]: r["cluster"] for r in V.communities(edges, nodes).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert set(found) == set(comp) and all(comp[found[k]] == comp[k] for k in comp)


def brute_allocation(sizes, num, cap):
    """One each, largest remainder on log1p, cut, refill the largest first."""
    import math

    ids = [k for k, n in sizes.items() if n > 0]
    w = {k: math.log1p(sizes[k]) for k in ids}
    raw = {k: (num - len(ids)) * w[k] / sum(w.values()) for k in ids}
    out = {k: 1 + math.floor(round(raw[k], 9)) for k in ids}
    for k in sorted(ids, key=lambda k: (-(round(raw[k], 9) - math.floor(round(raw[k], 9))), k))[: num - sum(out.values())]:
        out[k] += 1
    out = {k: min(n, cap, sizes[k]) for k, n in out.items()}
    need = num - sum(out.values())
    for k in sorted(ids, key=lambda k: (-sizes[k], k)):
        more = max(0, min(need, min(cap, sizes[k]) - out[k]))
        out[k] += more
        need -= more
    return out


def test_allocation(spark):
    rng = random.Random(4)
    for num, cap, sizes in [(8, 20, [0, 1, 4, 9, 16]), (30, 20, [0, 1, 4, 9, 16]), (40, 5, [rng.randint(1, 60) for _ in range(12)]), (99, 5, [3, 30, 40])]:
        df = spark.createDataFrame(list(enumerate(sizes)), "c long, size long")
        got = {r["c"]: r["k"] for r in P.allocate(df, "c", "size", num, cap).collect()}
        assert got == brute_allocation(dict(enumerate(sizes)), num, cap)
    few = P.allocate(spark.createDataFrame([(k, 5) for k in range(9)], "c long, size long"), "c", "size", 4, 20)
    assert sorted(r["k"] for r in few.collect()) == [0] * 5 + [1] * 4


def test_epoch_sampler_spreads_usage(spark):
    pool = [("a", k) for k in range(7)] + [("b", k) for k in range(5)]
    usage = dict.fromkeys(pool, 0)
    for epoch in range(6):
        df = spark.createDataFrame([(s, k, usage[s, k]) for s, k in pool], "src string, item long, usage long")
        got = P.epoch_sample(df, "src", "item", "usage", {"a": 7, "b": 5}, f"{epoch}").collect()
        assert len(got) == 12
        for r in got:
            usage[r["src"], r["item"]] += 1
    for s in "ab":
        counts = [n for (x, _), n in usage.items() if x == s]
        assert max(counts) - min(counts) <= 1


def test_take_target():
    assert [P.take_target(x, 10) for x in (None, 1.0, 0.35, 4, 99, 0, -1)] == [10, 10, 3, 4, 10, 0, 0]


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "s string, w double")
    assert {r["s"]: r["quota"] for r in P.largest_remainder(df, "w", 10, "s").collect()} == {"a": 7, "b": 3}


def test_token_roles(spark):
    pair = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    roles = X.token_roles(F.array(pair(0, 4), pair(3, 9), pair(9, 12), pair(20, 22)), F.array(pair(0, 5), pair(5, 12)))
    assert one(spark, roles) == [0, 1, 1, -1]
    assert one(spark, X.role_weights(roles, F.array(F.lit(0.2), F.lit(1.2)), 1.0)) == pytest.approx([0.2, 0.6, 0.6, 0.0])


def test_contract_names_the_bad_row(spark):
    rows = [([1, 2, 3], [1, 1, 1], [-100, 2, 3], [0.0, 0.2, 1.0], k) for k in range(20)] + [([1, 2, 3], [1, 1, 1], [-100, 2, 3], [0.0, 0.2], 20)]
    df = spark.createDataFrame(rows, "input_ids array<int>, attention_mask array<int>, labels array<int>, loss_weights array<double>, id int")
    assert X.first_bad_row(df, "id", 10, 8).first()["id"] == 20
    assert {r["rule"]: r["n"] for r in X.violation_counts(df, 10, 8).collect()}["unequal_lengths"] == 1


def test_transport_score():
    a = np.eye(3)
    assert Q.transport_score(a, a) == pytest.approx(1.0)
    assert Q.transport_score(a[:0], a[:0]) == 1.0 and Q.transport_score(a, a[:0]) == 0.0
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((4, 3)), rng.standard_normal((4, 3))))
        cost = np.clip(1 - x @ y.T, 0, 1)
        from itertools import permutations

        best = min(sum(cost[i, p[i]] for i in range(4)) / 4 for p in permutations(range(4)))
        assert Q.transport_score(x, y) == pytest.approx(1 - best)


def test_late_interaction_scores_whole_sets(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    sets = {k: np.stack(list(g.embedding)).astype(float) for k, g in e.groupby("label")}
    got = {(r["q"], r["doc"]): r["score"] for r in QUERIES["late_interaction"](spark, sf_dir).collect()}
    assert set(got) == {(a, b) for a in sets for b in sets if a != b}
    assert all(v == pytest.approx((sets[a] @ sets[b].T).max(1).sum(), abs=2e-6) for (a, b), v in got.items())
    small = Q.max_sim_sets(spark.createDataFrame(e[["label", "vec_id", "embedding"]]), "label", "vec_id", "embedding", 7)
    assert {(r["q"], r["doc"]): round(r["score"], 6) for r in small.collect()} == pytest.approx(got)


def test_mover_score_of_unequal_sets(spark):
    from itertools import permutations

    rng = np.random.default_rng(3)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((2, 3)), rng.standard_normal((4, 3))))
    cost = np.clip(1 - np.repeat(x, 2, 0) @ y.T, 0, 1)
    best = min(sum(cost[i, p[i]] for i in range(4)) / 4 for p in permutations(range(4)))
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<array<double>>, b array<array<double>>")
    assert df.select(Q.mover_score(F.col("a"), F.col("b")).alias("m")).first()["m"] == pytest.approx(1 - best)


def test_recommendations_have_a_row_for_every_query(spark):
    q = spark.createDataFrame([(1,), (2,)], "q long")
    f = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 3, 3), (1, 4, 4)], "q long, doc long, rank long")
    got = {r["q"]: r["recommended"] for r in Q.recommendation_records(q, f, "q", "doc", [F.col("rank")], 2).collect()}
    assert got == {1: [3, 4], 2: []}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x")], "k int, l array<string>, s string")
    files.write_shards(df, str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p"), ["k"]).columns == ["k"]
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "k int, l string, s string").first()["l"] == '["a"]'
    (tmp_path / "j.jsonl").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    assert files.read_json_lenient(spark, str(tmp_path / "j.jsonl"), "k int").count() == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_json_strict(spark, str(tmp_path / "j.jsonl"), "k int").collect()
    (tmp_path / "u.csv").write_text("label\n B \na\nb\n")
    assert [r["label"] for r in files.read_universe(spark, str(tmp_path / "u.csv"), "label").orderBy("pos").collect()] == ["b", "a"]
    assert files.scope_ids({"generation_completed_source_ids": [], "inserted_source_ids": ["b", " a", "b", None]}) == ["b", "a"]
    assert files.scope_ids(["x"]) == ["x"] and files.scope_ids({"inserted_source_ids": []}) == []
    with pytest.raises(ValueError, match="manifest"):
        files.scope_ids({})
    assert files.normalize_stages("judge, Fetch,recommend") == ["fetch", "judge", "similarity"]
    assert files.normalize_stages(["all"]) == list(files.STAGES)
    with pytest.raises(ValueError, match="stages"):
        files.normalize_stages("nope")
    assert files.cache_action(None, df, "k") == "write" and files.cache_action(df, df, "k") == "skip"
    bigger = spark.createDataFrame([(1,), (2,)], "k int")
    assert files.cache_action(df, bigger, "k") == "upgrade"


def test_stream_appends_each_key_once(spark, tmp_path):
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "e")]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = incremental.ingest_new(
            incremental.read_stream(spark, str(tmp_path / "in"), "k int, v string"), str(tmp_path / "out"), ["k"], ["v"], str(tmp_path / "ck")
        )
        q.awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in got] == [(1, "a"), (2, "b"), (3, "d")]


def test_trainer_rows_meet_the_contract(spark, sf_dir):
    from spindrift.plans.catalog import QUERIES

    rows = QUERIES["trainer_features"](spark, sf_dir)
    assert rows.count() > 5
    assert all(r["n"] == 0 for r in X.violation_counts(rows, 50_257, 512).collect())
    assert X.inconsistent_rows(rows, "row_id").count() == 0


def test_tokens(spark):
    from spindrift.functions import tokens

    path = "/opt/tokenizers/byte_bpe_50k.json"
    df = spark.createDataFrame([("hello world again",), ("",), (None,)], "t string")
    got = df.select(tokens.count_tokens(F.col("t"), path).alias("n"), tokens.truncate_tokens(F.col("t"), path, 2).alias("h"), tokens.token_segments(F.col("t"), path).alias("s")).collect()
    assert [r["n"] for r in got] == [3, 0, 0] and [r["h"] for r in got] == ["hello world", "", None]
    assert [tuple(x) for x in got[0]["s"]] == [(0, 5), (5, 11), (11, 17)]


def test_embedding_slot(spark):
    from spindrift.operators import embedding

    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    got = embedding.embed(df, "t", lambda ts: [[float(len(t))] for t in ts]).collect()
    assert sorted(r["embedding"][0] for r in got) == [1.0, 2.0]
    with pytest.raises(Exception, match="empty text"):
        embedding.embed(spark.createDataFrame([(" ",)], "t string"), "t", lambda ts: [[0.0]] * len(ts)).collect()


def test_paragraphs_by_their_rules():
    from spindrift.operators import coverage as C

    s = lambda n, end=".": "w" * (n - 1) + end
    assert C.paragraphs_of(None) == [] and C.paragraphs_of(" \r\n ") == []
    assert C.paragraphs_of("One  a.\r\n\r\nTwo\tb.\nstill two") == ["One a.", "Two b.\nstill two"]
    assert C.paragraphs_of("first  line\n second\tline \n") == ["first line", "second line"]
    assert C.paragraphs_of(f"{s(340)} {s(339)}") == [f"{s(340)} {s(339)}"]  # 680 characters: whole
    assert C.paragraphs_of(s(900)) == [s(900)]  # one sentence
    # closed at 380 characters only with three sentences
    assert C.paragraphs_of(" ".join([s(200)] * 4)) == [" ".join([s(200)] * 3), s(200)]
    assert C.paragraphs_of(" ".join([s(300)] * 3)) == [" ".join([s(300)] * 2), s(300)]
    # a tail under 180 joins whatever the length
    assert C.paragraphs_of(" ".join([s(200), s(200), s(210), s(100)])) == [" ".join([s(200), s(200), s(210), s(100)])]
    # a quotation mark ends a sentence with its stop
    a = s(228, '."')
    assert C.paragraphs_of(" ".join([s(229, "!"), a, s(229, "?"), s(300)])) == [" ".join([s(229, "!"), a]), f"{s(229, '?')} {s(300)}"]


def test_covering_selection(spark):
    from spindrift.operators import coverage as C

    assert C.greedy_cover([frozenset("ab"), frozenset("bcd"), frozenset("a")], set("abcd")) == [1, 0]
    assert C.greedy_cover([], {"x"}) == [] and C.greedy_cover([frozenset()], set()) == []
    rng = random.Random(2)
    rows = [(k, k % 2, rng.sample("abcdefgh", rng.randint(0, 3))) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, split long, labels array<string>").repartition(5)
    labels = {k: set(v) for k, _, v in rows}
    for target in (12, 40, 2):
        got = C.cover_by_split(df, "split", "id", "labels", target).collect()
        assert len({r["id"] for r in got}) == len(got)
        for x in (0, 1):
            ids = [r["id"] for r in got if r["split"] == x]
            assert len(ids) == min(target, 30) and all(k % 2 == x for k in ids)
            need = set().union(*(labels[k] for k in labels if k % 2 == x))
            assert target == 2 or set().union(*(labels[k] for k in ids)) == need
    assert sorted(map(tuple, C.cover_by_split(df, "split", "id", "labels", 12).collect())) == sorted(map(tuple, C.cover_by_split(df.repartition(3), "split", "id", "labels", 12).collect()))
