"""Published values of the controlled corpus that need no model weights."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import attack, metrics, retrieve, select
from tallyloom.sources import corpus

N = None
#: (rate, rule, epsilon): the ten means.
GOLDEN = {
    (N, "vanilla", N): (0.0, 0.0, 0.466667, 0.285947, 0.466667, 0.0, N, N, 0.083333, 5.047133),
    (N, "repr_group", 0.0): (0.05, 0.025513, 0.5, 0.311278, 0.5, 0.0, N, N, 0.083333, 5.047133),
    (N, "repr_both", 1.0): (0.0, 0.0, 0.483333, 0.29143, 0.483333, 0.0, N, N, 0.083333, 5.047133),
    (N, "repr_both", 0.0): (0.025, 0.019704, 0.416667, 0.238639, 0.416667, 0.05, N, N, 0.070833, 5.047133),
    (0.005, "vanilla", N): (0.1625, 0.080566, 0.5, 0.311278, 0.5, 0.74359, 0.75, 0.6875, 0.0125, 6.95874),
    (0.005, "repr_group", 1.0): (0.1625, 0.080566, 0.5, 0.311278, 0.5, 0.74359, 0.75, 0.6875, 0.0125, 6.95874),
    (0.005, "repr_group", 0.0): (0.1875, 0.075403, 0.5, 0.311278, 0.5, 0.705128, 0.75, 0.6875, 0.0125, 6.728534),
    (0.005, "repr_both", 1.0): (0.325, 0.330832, 0.453846, 0.269574, 0.453846, 0.166667, 0.75, 0.625, 0.016667, 6.680269),
    (0.005, "repr_both", 0.0): (0.16875, 0.092909, 0.474359, 0.288928, 0.474359, 0.576923, 0.75, 0.6125, 0.016667, 6.772572),
    (0.02, "vanilla", N): (0.11875, 0.037343, 0.5, 0.311278, 0.5, 0.7, 0.75, 0.75, 0.0, 6.393764),
    (0.02, "repr_group", 0.0): (0.18125, 0.079656, 0.5, 0.311278, 0.5, 0.769231, 0.75, 0.75, 0.0, 6.383637),
    (0.02, "repr_both", 1.0): (0.40625, 0.412634, 0.5, 0.311278, 0.5, 0.0, 0.75, 0.75, 0.0, 6.368445),
    (0.02, "repr_both", 0.0): (0.18125, 0.111751, 0.474359, 0.288928, 0.474359, 0.782051, 0.75, 0.75, 0.0, 6.378573),
}


@pytest.fixture(scope="module")
def world(spark):
    c = corpus.controlled(spark)
    rows = [tuple(r) for r in c["docs"].orderBy("ord").collect()]
    assert len(rows) == 1824 and c["queries"].count() == 48
    fetched = {}
    for rate in (None, 0.005, 0.02):
        docs = c["docs"] if rate is None else c["docs"].unionByName(spark.createDataFrame(corpus.controlled_poison(rows, rate), corpus.DOCS))
        fetched[rate] = (docs, retrieve.top_by_text(docs, c["queries"], 15, zeros=True).join(docs, "ord").withColumn("cell_id", F.lit(1)).drop("rnk").cache())
    return c, fetched


@pytest.mark.parametrize("cell", GOLDEN, ids=str)
def test_published_values(spark, world, cell):
    rate, rule, eps = cell
    c, fetched = world
    docs, rows = fetched[rate]
    keys = ["cell_id", "qid"]
    if rule == "vanilla":
        chosen = select.vanilla(rows, keys, 5)
    elif rule == "repr_group":
        chosen = select.group_budget(rows, keys, 5, eps)
    else:
        chosen = select.stance_budget(rows, keys, 5, eps, "both").join(docs, "ord")
    clean = select.vanilla(fetched[None][1], keys, 5)
    attacked = spark.createDataFrame([(1,)] if rate else [], "cell_id int")
    means = metrics.means(metrics.evaluate(chosen, clean, docs, c["queries"], c["strata"], c["pool"], attacked), ["cell_id"]).first()
    assert tuple(None if means[m] is None else round(means[m], 6) for m in metrics.METRICS) == pytest.approx(GOLDEN[cell], abs=1.1e-6)
    assert means["n_valid_stance_gap"] <= means["n_queries"] == 48


#: (rule, lambda): drift_tv, drift_js, stance_shift, stance_gap, poison_in_topk, poison_share,
#: in_pool_rate, mean_score and usage of the hashed vectors at rate 0.005.
PUSHED = {
    ("manifold", 0.0): (0.2625, 0.182335, 0.5, 0.6, 0.25, 0.225, 0.054167, -1.987133, 1.0),
    ("manifold", 1.0): (0.23125, 0.138916, 0.5, 0.916667, 0.9375, 0.9375, 0.0, -8.534385, 0.945284),
    ("repr_both", 0.0): (0.15, 0.140162, 0.472222, 0.375, 0.625, 0.525, 0.016667, 0.518121, 1.0),
    ("repr_both", 0.25): (0.235417, 0.238847, 0.5, 0.4, 0.875, 0.7875, 0.0, 0.574797, 0.993849),
    ("repr_both", 1.0): (0.28125, 0.370839, 0.5, 0.75, 1.0, 0.9875, 0.0, 0.839238, 0.945284),
    ("repr_both", 4.0): (0.26875, 0.39797, 0.5, N, 1.0, 1.0, 0.0, 2.016556, 0.809116),
}


@pytest.fixture(scope="module")
def pushed(spark, world):
    c, fetched = world
    docs = fetched[0.005][0]
    vectors = lambda df, key: retrieve.to_dense(df, retrieve.hash_embed(df, key), key)
    q = vectors(c["queries"], "qid").cache()
    v = vectors(docs, "ord").join(docs.select("ord", "is_poison"), "ord").cache()
    clean = v.filter("not is_poison")
    base = retrieve.vector_top_k(clean.select("ord", "v"), q, 5).join(docs, "ord").withColumn("cell_id", F.lit(1)).cache()
    return c, docs, q, v, base, select.manifold(clean)


@pytest.mark.parametrize("cell", PUSHED, ids=str)
def test_published_values_of_pushed_vectors(spark, pushed, cell):
    rule, lam = cell
    c, docs, q, v, base, model = pushed
    moved = attack.projected(v, q, lam)
    keys = ["cell_id", "qid"]
    fetched = retrieve.vector_top_k(moved.select("ord", "v"), q, 15).join(docs, "ord").withColumn("cell_id", F.lit(1)).drop("rnk")
    if rule == "manifold":  # the penalty looks at the texts' own vectors, not at the pushed ones
        chosen = select.penalised(fetched.join(v.select("ord", "v"), "ord"), keys, 5, model)
    else:
        chosen = select.stance_budget(fetched, keys, 5, 0.25, "both").join(docs, "ord")
    per_query = metrics.evaluate(chosen, base, docs, c["queries"], c["strata"], c["pool"], spark.createDataFrame([(1,)], "cell_id int"))
    r = metrics.means(per_query, ["cell_id"]).first()
    used = attack.usage(v.filter("is_poison"), moved.filter("is_poison")).first()[0]
    got = (*[r[m] for m in ("drift_tv", "drift_js", "stance_shift", "stance_gap", "poison_in_topk", "poison_share", "in_pool_rate", "mean_score")], used)
    assert tuple(None if x is None else round(x, 6) for x in got) == pytest.approx(PUSHED[cell], abs=1.1e-6)


def test_grid_runs_as_one_plan(spark, world):
    from tallyloom.operators import reports
    from tallyloom.plans import sweep

    c, _ = world
    out = sweep.run(spark, c, {"attacks": ["clean", "template"], "rates": [0.005], "retrievers": ["bm25"], "epsilons": [0.0, 1.0], "others": []})
    assert out["cells"].count() == 2 * (1 + 3 * 2)
    rows = {(r.attack, r.defense, r.epsilon): r for r in out["aggregate"].collect()}
    assert len(rows) == 14 and all(r.n_queries == 48 for r in rows.values())
    for key in ((None, "vanilla", None), (None, "repr_group", 0.0), (None, "repr_both", 1.0), (None, "repr_both", 0.0)):
        got = rows["clean", key[1], key[2]]
        assert tuple(None if got[m] is None else round(got[m], 6) for m in metrics.METRICS) == pytest.approx(GOLDEN[key], abs=1.1e-6)
    assert rows["template", "vanilla", None].poison_share > 0.3
    assert out["by_stratum"].count() == 14 * 4
    views = reports.summary(out["aggregate"])
    assert reports.markdown(views["attack effect"]).count("\n") == 3
    assert reports.as_json(out["aggregate"], ["attack"]).first().body.startswith("{")


def test_grid_of_pushed_vectors_has_the_published_values(spark):
    from tallyloom.plans import sweep

    config = {"rates": [0.005], "retrievers": ["dense", "bm25"], "modes": ["both"], "epsilons": [0.25]}
    rows = {(r.attack, r.retriever, r.defense): r for r in sweep.controlled(spark, config).collect()}
    assert len(rows) == 3 * (4 + 3) and ("clean", "bm25", "manifold") not in rows
    for attack_, lam in (("template", 0.0), ("template_plus_projection", 1.0)):
        for rule in ("manifold", "repr_both"):
            r = rows[attack_, "dense", rule]
            got = [r[m] for m in ("drift_tv", "drift_js", "stance_shift", "stance_gap", "poison_in_topk", "poison_share", "in_pool_rate", "mean_score")]
            assert [None if x is None else round(x, 6) for x in got] == pytest.approx(list(PUSHED[rule, lam][:8]), abs=1.1e-6)
    # a push changes nothing for lexical retrievers
    assert rows["template", "bm25", "multi_query"][5:] == rows["template_plus_projection", "bm25", "multi_query"][5:]


def test_world_round_trip(spark, world, tmp_path):
    from tallyloom.sources import files

    c, _ = world
    files.save_world(c, str(tmp_path))
    back = files.load_world(spark, str(tmp_path), {n: df.schema for n, df in c.items()})
    assert all(sorted(back[n].collect(), key=str) == sorted(df.collect(), key=str) for n, df in c.items())
