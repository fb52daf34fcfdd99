"""Hand-worked cases and invariants of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers, text
from tallyloom.operators import attack, generation, metrics, ranks, reports, retrieve, select, stats
from tallyloom.sources import corpus, files

DOCS = "ord long, doc_id string, text string, grp string, stance int, is_poison boolean"


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("word", "h"), [("hello", 1335831723), ("performed", 4271474707), ("x1", 274927234)])
def test_fnv(spark, word, h):
    assert one(spark, text.fnv1a, word) == h


def test_text_edges(spark):
    assert one(spark, text.tokens, None) is None
    assert one(spark, text.tokens, "") == []
    assert one(spark, text.strip_filler, "A b. The entry appears late. The finding was filed x") == "A b. The entry appears late."
    assert one(spark, text.strip_filler, "  plain ") == "plain"
    assert one(spark, text.parse_choice, " b) because") == "B"
    assert one(spark, text.parse_choice, "Abba") is None
    assert one(spark, text.parse_yes_no, "no way") is False
    assert one(spark, text.invert_stance, "highest and lowest, Better") == "lowest and highest, Worse"
    assert one(spark, text.plain_group, " Night-Shift ") == "nightshift"
    assert one(spark, text.plain_group, "") is None


def test_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    inside = numbers.nan_to_null(df, ["v"])
    assert inside.agg(F.count("v")).first()[0] == 1
    assert all(math.isnan(r.v) for r in numbers.null_to_nan(inside, ["v"]).filter("isnan(v)").collect())


def small(spark):
    rows = [(3, "c", "red apple", "a", 1, False), (7, "d", "red apple", "b", -1, False), (9, "e", "green pear", None, 0, False), (11, "f", None, None, 0, False), (12, "g", "", "a", 1, False)]
    return spark.createDataFrame(rows, DOCS)


def test_ties_and_zero_scores(spark):
    docs = small(spark)
    q = spark.createDataFrame([("q1", "apple"), ("q2", "nothing here"), ("q3", "APPLE")], "qid string, text string")
    got = {(r.qid, r.rnk): r.ord for r in retrieve.top_by_text(docs, q, 3, zeros=True).collect()}
    assert [got["q1", i] for i in (1, 2, 3)] == [3, 7, 9]
    assert [got["q3", i] for i in (1, 2, 3)] == [3, 7, 9]
    assert [got["q2", i] for i in (1, 2, 3)] == [3, 7, 9]


def test_empty_tables(spark):
    docs = small(spark).limit(0)
    q = spark.createDataFrame([("q1", "apple")], "qid string, text string")
    for kind in ("bm25", "dense", "splade"):
        assert retrieve.build_retriever(kind)(docs, q).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        retrieve.build_retriever("x")


def test_vectors_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "ord long, v array<double>")
    q = v.filter("ord < 20").select(F.col("ord").alias("qid"), "v")
    got = {(r.qid, r.rnk): r.ord for r in retrieve.vector_top_k(v, q, 4, block=64).collect()}
    best = np.argsort(-np.round(x[:20] @ x.T, 9), axis=1, kind="stable")[:, :4]
    assert all(got[i, j + 1] == best[i, j] for i in range(20) for j in range(4))


def test_encoder_sees_each_text_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "k long, t string")
    out = {r.k: r.v for r in retrieve.encode(df, "k", "t", lambda ts: np.array([[len(t), 1.0] for t in ts]), "p: ").collect()}
    assert out == {1: [4.0, 1.0], 2: [4.0, 1.0], 3: [5.0, 1.0]}


def test_projection(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "v array<double>, q array<double>")
    assert v.select(attack.project(F.col("v"), F.col("q"), F.lit(1.0))).first()[0] == [1.5, 0.5]
    zero = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "v array<double>, q array<double>")
    assert zero.select(attack.project(F.col("v"), F.col("q"), F.lit(3.0))).first()[0] == [1.0, 0.0]
    assert zero.select(attack.cosine(F.col("v"), F.col("q"))).first()[0] == 1.0


def test_budget(spark):
    rates = spark.createDataFrame([(0.001,), (0.0025,), (0.005,), (0.01,), (0.02,)], "r double")
    assert [r[0] for r in rates.select(attack.budget(F.col("r"), F.lit(1824))).collect()] == [2, 5, 9, 18, 36]


def test_swap_keeps_size(spark):
    docs = spark.createDataFrame([(i, f"d{i}", "t", "a" if i < 4 else "b", 1, False) for i in range(6)], DOCS)
    out = attack.swapped(docs, "a", "b", 3)
    assert out.count() == 6
    assert sorted(r.doc_id for r in out.collect()) == ["d3", "d4", "d4", "d4", "d5", "d5"]


def test_places_equal_row_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(["a", "b", None][rng.integers(3)], int(o)) for o in rng.choice(10**6, 700, replace=False)]
    got = {(r.k, r.o): r.place for r in ranks.place(spark.createDataFrame(rows, "k string, o long"), ["k"], "o", width=5000).collect()}
    for k in ("a", "b", None):
        own = sorted(o for g, o in rows if g == k)
        assert [got[k, o] for o in own] == list(range(1, len(own) + 1))


def test_first_favourable_is_passed_over():
    got, trace = select.constrained([1, 2, 3], ["a", "a", "a"], [1, 1, -1], [3.0, 2.0, 1.0], 2, 1.0, "stance")
    assert sorted(got) == [0, 2]
    assert trace["fallback"] == 1 and trace["repaired"] == 0


def test_stance_mode_keeps_the_group_cap():
    args = ([1, 2, 3, 4, 5], ["a", "a", "a", "b", "b"], [-1] * 5, [5.0, 4.0, 3.0, 2.0, 1.0], 4)
    assert select.constrained(*args, 0.0, "stance")[0] == [0, 1, 3, 4]
    assert select.constrained(*args, 0.0, "group")[0] == [0, 1, 3, 4]
    assert select.constrained(*args, 0.0, "stance", fixed=True)[0] == [0, 1, 2, 3]


def test_group_windows_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(5)
    rows = []
    for q in range(60):
        for o in range(int(rng.integers(1, 15))):
            g = [None, "a", "b", "c"][rng.integers(4)]
            rows.append((f"q{q}", o, g, int(rng.integers(-1, 2)) if g else 0, float(rng.integers(0, 6))))
    df = spark.createDataFrame(rows, "qid string, ord long, grp string, stance int, score double")
    for eps in (0.0, 0.2, 10.0):
        got = {}
        for r in select.group_budget(df, ["qid"], 5, eps).collect():
            got.setdefault(r.qid, set()).add(r.ord)
        for q in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == q]
            picked, _ = select.constrained([r[1] for r in own], [r[2] for r in own], [r[3] for r in own], [r[4] for r in own], 5, eps, "group")
            assert got[q] == {own[i][1] for i in picked}
            assert len(picked) == min(5, len(own))


def test_stance_budget_runs_grouped(spark):
    df = spark.createDataFrame([("q", 1, "a", 1, 3.0), ("q", 2, "a", 1, 2.0), ("q", 3, "a", -1, 1.0), ("r", 4, None, 0, 1.0)], "qid string, ord long, grp string, stance int, score double")
    got = {}
    for r in select.stance_budget(df, ["qid"], 2, 1.0, "stance").collect():
        got.setdefault(r.qid, []).append(r.ord)
    assert sorted(got["q"]) == [1, 3] and got["r"] == [4]


def evaluated(spark, chosen, reference):
    schema = "cell_id int, qid string, ord long, doc_id string, grp string, stance int, is_poison boolean, score double"
    docs = spark.createDataFrame([(1, "x", "t", "a", 1, False), (2, "y", "t", "b", -1, False)], DOCS)
    queries = spark.createDataFrame([(0, "q", "t", "s")], "qord long, qid string, text string, stratum string")
    strata = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "stratum string, gpos int, grp string")
    pool = spark.createDataFrame([("q", "x")], "qid string, doc_id string")
    cells = spark.createDataFrame([(1,)], "cell_id int")
    return metrics.evaluate(spark.createDataFrame(chosen, schema), spark.createDataFrame(reference, schema), docs, queries, strata, pool, cells).first()


def test_empty_profile(spark):
    r = evaluated(spark, [(1, "q", 5, "n", None, 0, False, 1.0)], [(1, "q", 1, "x", "a", 1, False, 1.0), (1, "q", 2, "y", "b", -1, False, 1.0)])
    assert (r.drift_tv, r.drift_js, r.stance_gap, r.poison_in_topk, r.in_pool_rate) == (0.5, None, None, 0.0, 0.0)


def test_js_of_one_sided(spark):
    r = evaluated(spark, [(1, "q", 1, "x", "a", 1, True, 1.0)], [(1, "q", 1, "x", "a", 1, False, 1.0), (1, "q", 2, "y", "b", -1, False, 1.0)])
    assert round(r.drift_js, 6) == 0.311278
    assert r.stance_gap is None and r.poison_share == 1.0 and r.in_pool_rate == 1.0


def test_auc_of_ties(spark):
    df = spark.createDataFrame([("g", 1.0, 1), ("g", 1.0, 0), ("h", 1.0, 1)], "k string, score double, label int")
    got = {r.k: r.auc for r in stats.auc(df, ["k"]).collect()}
    assert got == {"g": 0.5, "h": None}


def test_flip_of_zeros(spark):
    df = spark.createDataFrame([("g", i, 0.0) for i in range(4)], "k string, i int, value double")
    assert stats.sign_flip(df, ["k"], 20).first().p == 1.0


def test_bootstrap_covers_a_constant(spark):
    df = stats.numbered(spark.createDataFrame([("g", float(2)) for _ in range(9)], "k string, value double"), ["k"], ["value"])
    r = stats.bootstrap(df, ["k"], 50).first()
    assert (r.mean, r.low, r.high) == (2.0, 2.0, 2.0)


def test_generator_errors_are_rows(spark):
    def fails(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    prompts = spark.createDataFrame([("a",), ("bad",), ("a",), (None,)], "prompt string")
    got = {r.prompt: (r.reply, r.error) for r in generation.replies(prompts, fails).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: no")}
    cache = spark.createDataFrame([("a", "kept")], "prompt string, reply string")
    assert {r.prompt: r.reply for r in generation.replies(prompts, fails, cache).collect()} == {"a": "kept", "bad": None}
    assert generation.replies(prompts, generation.offline).filter("reply in ('A', 'B')").count() == 2


def test_files_round_trip(spark, tmp_path):
    df = files.union_all([spark.createDataFrame([(1, "x")], "a int, s string"), spark.createDataFrame([(2, 0.5)], "a int, d double")])
    assert df.columns == ["a", "s", "d"]
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(files.read_csv(spark, str(tmp_path / "c"), df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "q.csv").write_text("a,v\n1,nan\n2,0.5\n3,\n")
    runs = files.read_runs(spark, str(tmp_path / "*" / "q.csv"), "a int, v double")
    assert {r.run_tag for r in runs.collect()} == {"run1"}
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), {"k": 1}, make).count() == 2
    assert calls == [1]
    (tmp_path / "r.json").write_text('{"generators": [{"generator": "g", "records": [{"qid": "q", "x": 1}]}]}')
    assert files.read_records(spark, str(tmp_path / "r.json")).first().asDict() == {"generator": "g", "qid": "q", "x": 1}
    assert files.merged_config({"a": 1, "b": 1}, {"b": 2}, {"a": 3}) == {"a": 3, "b": 2}
    assert reports.phantom_columns(df, ["a", "zz"]) == {"missing": ["zz"], "unclaimed": ["d", "s"]}


def test_question_records(spark, tmp_path):
    rec = '{"context": "C", "question": "%s", "question_polarity": "%s", "ans0": "the old", "ans1": "the young", "ans2": "unknown", "answer_info": {"ans0": ["x", "old"], "ans1": ["y", "nonOld"], "ans2": ["z", "unknown"]}, "additional_metadata": {"stereotyped_groups": [%s]}}'
    lines = [rec % ("Who?", "neg", '"old"'), rec % ("Who?", "nonneg", '"old"'), rec % ("When?", "neg", '"old"'), rec % ("Who?", "neg", ""), rec % ("Who?", "neg", '"other"')]
    lines.append('{"context": "C", "question": "Who?", "question_polarity": "neg", "ans0": "the old", "answer_info": {"ans0": ["x", "old"]}, "additional_metadata": {"stereotyped_groups": ["young"]}}')
    (tmp_path / "Age.jsonl").write_text("\n".join(lines) + "\n")
    got = corpus.question_records(spark, str(tmp_path), least=3)
    docs = [(r.doc_id, r.grp, r.stance) for r in got["docs"].orderBy("ord").collect()]
    assert docs == [("BBQ-Age-000000", "elderly", -1), ("BBQ-Age-000001", "young", 1), ("BBQ-Age-000002", "elderly", 1), ("BBQ-Age-000003", "young", -1), ("BBQ-Age-000004", "elderly", -1), ("BBQ-Age-000005", "young", 1), ("BBQ-Age-000006", "elderly", 1)]
    assert [(r.qid, r.text) for r in got["queries"].collect()] == [("age-q0000", "Who?")]
    assert got["pool"].count() == 5


def test_streaming_monitor(spark, tmp_path):
    from tallyloom.streaming import monitor

    schema = "cell_id long, qid string, doc_id string, grp string, stance int, is_poison boolean, score double, loaded_at timestamp"
    rows = spark.sql("select 1L cell_id, 'q' qid, concat('d', id % 3) doc_id, 'a' grp, 1 stance, id = 0 is_poison, 1D score, timestamp'2025-01-01 10:00:00' loaded_at from range(4)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    once = monitor.fresh(stream, ["cell_id", "qid", "doc_id"])
    monitor.run_once(once, "once", str(tmp_path / "c1"), "append")
    assert spark.table("once").count() == 3
    monitor.run_once(monitor.windowed_shares(stream), "shares", str(tmp_path / "c2"))
    r = spark.table("shares").first()
    assert (r.n, r.poison_share, r.favourable, r.n_relevant) == (4, 0.25, 1.0, 4)


def test_manifold_finds_what_leaves_it(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 2)) @ rng.standard_normal((2, 6)) + 0.01 * rng.standard_normal((200, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "ord long, v array<double>")
    mean, basis, mu, sd = select.manifold(v, 2)
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    d = np.linalg.norm(c - (c @ vt[:2].T) @ vt[:2], axis=1)
    assert np.allclose([mu, sd], [d.mean(), d.std() + 1e-9], atol=1e-8)
    odd = spark.createDataFrame([("q", 1, 1.0, x[0].tolist()), ("q", 2, 1.1, (x[1] + 5).tolist())], "qid string, ord long, score double, v array<double>")
    assert select.penalised(odd, ["qid"], 1, (mean, basis, mu, sd)).first().ord == 1
    assert metrics.effective_dimension([1.0, 1.0, 0.0]) == pytest.approx(2.0)


def test_unmatched_documents_count_in_outranked_and_margins(spark):
    docs = spark.createDataFrame([(i, i == 3 or i == 4) for i in range(10)], "ord long, is_poison boolean")
    scored = spark.createDataFrame([("q", 0, 1.0, False), ("q", 1, 3.0, False), ("q", 3, 2.0, True)], "qid string, ord long, score double, is_poison boolean")
    queries = spark.createDataFrame([("q",), ("none",)], "qid string")
    got = {(r.qid, r.ord): r.fraction for r in metrics.outranked(scored, docs, queries).collect()}
    assert got == {("q", 3): 7 / 8, ("q", 4): 0.0, ("none", 3): 0.0, ("none", 4): 0.0}
    margin = lambda k: {r.qid: (r.margin, r.hit) for r in metrics.margins(scored, docs, queries, k).collect()}
    assert margin(2) == {"q": (1.0, True), "none": (0.0, False)}
    assert margin(5) == {"q": (2.0, True), "none": (0.0, False)}
    assert margin(9) == {"q": (None, None), "none": (None, None)}


def test_queries_resample_as_often_as_surveyed(spark, monkeypatch):
    from tallyloom.plans import queries as core

    diffs = spark.createDataFrame([("s", i, 12, 0.1 + i / 100) for i in range(12)], "stratum string, i int, n int, value double")
    monkeypatch.setattr(core, "_diffs", lambda s, d: diffs)
    p = core.paired_permutation(spark, None).first().p
    assert 0 < p < 0.0015  # 2 of 4096 sign patterns
    asked = {}
    monkeypatch.setattr(core, "_by_query", lambda s, d: spark.createDataFrame([("s", f"q{i}", 0.1, 0.2) for i in range(3)], "stratum string, qid string, clean double, attacked double"))
    for name in ("bootstrap", "two_sample"):
        real = getattr(stats, name)
        monkeypatch.setattr(stats, name, lambda *x, real=real: asked.setdefault(x[-1], x[-2]) and real(*x))
    core.bootstrap_ci(spark, None), core.paired_bootstrap(spark, None), core.two_sample_bootstrap(spark, None)
    assert asked == {11: 5000, 12: 10_000, 14: 2000}


def test_summarise_condition(spark):
    schema = "cond string, answer_id long, qid string, answer string, error string, n_poison_in_context int, context_ids array<string>"
    rows = [("c", 1, "q1", "x", None, 2, ["d1", "d2"]), ("c", 2, "q2", "y", "nan", 0, ["d1", "gone"]), ("c", 3, "q3", None, "HTTP 500", 5, ["d1"]), ("c", 4, "q4", "", None, 5, ["d1"]), ("e", 5, "q1", None, "HTTP 500", 1, [])]
    records = spark.createDataFrame(rows, schema)
    docs = spark.createDataFrame([("d1", "one"), ("d2", "two")], "doc_id string, text string")
    pairs = {(r.answer_id, r.pos): (r.premise, r.hypothesis) for r in generation.passage_expansion(records, docs).collect()}
    assert pairs == {(1, 0): ("one", "x"), (1, 1): ("two", "x"), (2, 0): ("one", "y"), (2, 1): ("", "y")}
    stance = spark.createDataFrame([(1, 0, 0.5), (1, 1, -0.5), (2, 0, 0.25), (2, 1, 0.5), (4, 0, 1.0), (4, 1, 0.0)], "answer_id long, gpos int, stance double")
    parts = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1), (2, 0, 0.4), (3, 0, 1.0)], "answer_id long, pos int, p double")
    got = {r.cond: r.asDict() for r in generation.summarise_condition(records, stance, parts, ["cond"], 500).collect()}
    c = got["c"]
    assert (c["n"], c["n_ok"], c["n_errors"]) == (4, 2, 1)
    assert (c["fav_g1"], c["fav_g2"], c["stance_gap"]) == (0.375, 0.0, 0.625)
    assert (c["stance_gap_lo"], c["stance_gap_hi"]) == (0.25, 1.0)
    assert (c["eae_d"], c["unattributed_rate"], c["poison_in_context"]) == (0.45, 0.75, 1.0)
    assert (got["e"]["n"], got["e"]["n_ok"], got["e"]["n_errors"], got["e"]["stance_gap"]) == (1, 0, 1, None)


def test_variants_drop_any_word_and_differ(spark):
    texts = [(f"q{i}", " ".join(f"w{j}" for j in range(6))) for i in range(100)] + [("one", "word"), ("none", "")]
    rows = select.variants(spark.createDataFrame(texts, "qid string, text string"), 5).collect()
    full = dict(texts)
    assert all(r.text == full[r.qid] for r in rows if r.v == 0 or r.qid in ("one", "none"))
    cut = [r.text.split() for r in rows if r.v and r.qid.startswith("q")]
    assert len(cut) == 500 and all(1 <= len(c) < 6 for c in cut)
    assert all(60 < sum(f"w{j}" not in c for c in cut) < 170 for j in range(6))
    different = [len({r.text for r in rows if r.qid == f"q{i}" and r.v}) for i in range(100)]
    assert sum(different) / 100 > 3.4
