"""The core queries: each operator over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import counter_random, defined, mixed
from ..operators import attack, generation, metrics, reports, retrieve, select, stats
from ..session import cut
from ..sources.tables import table
from . import sweep

K = 5
LAMBDAS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)
MEASURES = ["drift_tv", "drift_js", "stance_shift", "stance_div", "stance_onesided", "stance_gap", "poison_in_topk", "poison_share", "in_pool_rate", "mean_score"]


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "docs").select("ord", "doc_id", "text", T.plain_group(F.col("grp")).alias("grp"), "stance", "is_poison")


def queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "queries").select("qord", "qid", "text", "stratum")


def strata(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "strata")


def pooled(s: SparkSession, d: str, chosen: DataFrame) -> DataFrame:
    """The selected rows with ``pooled``: whether they are in their query's candidate pool, which is
    every fiftieth document by corpus order. Looked up from the k rows of each query; the pool
    itself is never built."""
    q = retrieve.small_side(queries(s, d).select("qid", F.pmod("qord", F.lit(50)).alias("m")))
    of = docs(s, d).select("doc_id", F.pmod("ord", F.lit(50)).alias("at"))
    return chosen.join(of, "doc_id", "left").join(q, "qid", "left").withColumn("pooled", F.coalesce(F.col("at") == F.col("m"), F.lit(False))).drop("at", "m")


def listed(s: SparkSession, d: str) -> DataFrame:
    """Each document once per (cell, query), with its best score; sent-again rows collapse."""
    r = table(s, d, "retrieved").filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return r.groupBy("cell_id", "qid", "doc_id").agg(F.max(F.col("score") + F.lit(0.0)).alias("score"), F.min("ord").alias("ord"), F.min(T.plain_group(F.col("grp"))).alias("grp"), F.min("stance").alias("stance"), F.max("is_poison").alias("is_poison"))


def selection(s: SparkSession, d: str, k: int = K) -> DataFrame:
    return retrieve.top_k(listed(s, d), ["cell_id", "qid"], k)


def reference(s: SparkSession, d: str) -> DataFrame:
    """(cell_id, ref): for each cell, the first clean, undefended cell with its retriever and
    backbone."""
    c = table(s, d, "cells")
    clean = c.filter((F.col("attack") == "clean") & (F.col("defense") == "vanilla")).groupBy(F.col("retriever").alias("r"), F.col("backbone").alias("b")).agg(F.min("cell_id").alias("ref"))
    return c.join(clean, F.col("retriever").eqNullSafe(F.col("r")) & F.col("backbone").eqNullSafe(F.col("b"))).select("cell_id", "ref")


def per_query(s: SparkSession, d: str) -> DataFrame:
    chosen = cut(selection(s, d))  # k rows a key, read for profiles and for hits
    attacked = table(s, d, "cells").filter(F.col("attack") != "clean").select("cell_id")
    return metrics.evaluate(chosen, reference(s, d), docs(s, d), queries(s, d), strata(s, d), lambda rows: pooled(s, d, rows), attacked)


def _metric(*names: str):
    return lambda s, d: per_query(s, d).select("cell_id", "qid", *names)


# text and hashes
def tokenize(s, d):
    t = T.tokens(F.col("text"))
    return docs(s, d).filter(F.col("text").isNotNull()).select("ord", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def fnv_hash(s, d):
    words = queries(s, d).select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    h = T.fnv1a(F.col("term"))
    return words.select("term", h.alias("h"), T.hash_place(h, 512).alias("idx"), T.hash_sign(h).alias("sign"))


def strip_filler(s, d):
    return docs(s, d).filter(F.col("text").isNotNull()).select("ord", T.strip_filler(F.concat(F.col("text"), F.lit(T.FILLERS[1] + " later."))).alias("core"))


def align_prefix(s, d):
    n = F.lit(9)
    return s.range(9).select(F.col("id").alias("i"), T.align_words(F.col("id"), n, 0.8).alias("words"))


def prompts(s, d):
    q = queries(s, d).select("qid", "text")
    held = selection(s, d, 3).groupBy("qid", "cell_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "doc_id"))).alias("l"))
    context = T.format_context(F.transform("l", lambda x: x["doc_id"]))
    return held.join(q, "qid").select("cell_id", "qid", T.choice_prompt(F.col("text"), context, F.lit("first"), F.lit("second")).alias("prompt"))


def parsed_choices(s, d):
    a = generation.latest(table(s, d, "answers"))
    return a.select("answer_id", T.parse_choice(F.col("answer")).alias("choice"), T.parse_yes_no(F.col("answer")).alias("said_yes"), T.shorten(F.col("answer"), 40).alias("short"))


def inverted(s, d):
    return docs(s, d).filter(F.col("text").isNotNull()).select("ord", T.invert_stance(F.col("text")).alias("text"))


# retrieval
def bm25_index_stats(s, d):
    return retrieve.term_stats(docs(s, d))


def bm25_topk(s, d):
    return retrieve.top_by_text(docs(s, d), queries(s, d), K, "bm25", zeros=True)


def hash_embed(s, d):
    return retrieve.hash_embed(docs(s, d)).select("ord", "idx", F.round("w", 9).alias("w"))


def hash_dense_topk(s, d):
    return retrieve.top_by_text(docs(s, d), queries(s, d), K, "dense")


def sparse_dot_topk(s, d):
    return retrieve.top_by_text(docs(s, d), queries(s, d), K, "splade")


def _vectors(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"), (F.col("vec_id") % 50 == 7).alias("is_poison"))
    return v


def _vector_queries(v):
    return v.filter(F.col("ord") % 50 == 0).select(F.col("ord").alias("qid"), "v")


def embedding_topk(s, d):
    v = _vectors(s, d)
    return retrieve.vector_top_k(v, _vector_queries(v), K).select("qid", "rnk", "ord", "score")


# injection
def poison_budget(s, d):
    n = docs(s, d).filter(~F.col("is_poison")).agg(F.count(F.lit(1)).alias("n"))
    rates = s.createDataFrame([(r,) for r in (0.001, 0.0025, 0.005, 0.01, 0.02)], "rate double")
    return rates.crossJoin(F.broadcast(n)).select("rate", attack.budget(F.col("rate"), F.col("n")).alias("per_stratum"), attack.bound(F.lit(0.25), F.col("n")).cast("long").alias("bound"))


def injected_passages(s, d):
    return attack.injected(docs(s, d), strata(s, d), 20).select("stratum", "i", "doc_id", "text", "grp", "stance")


def corpus_union_ties(s, d):
    all_docs = attack.appended(docs(s, d).filter(~F.col("is_poison")), attack.injected(docs(s, d), strata(s, d), 20))
    return all_docs.select("ord", "doc_id", "grp", "stance", "is_poison")


def subspace_project(s, d):
    v = _vectors(s, d)
    out = attack.projected(v, _vector_queries(v), 1.0).filter("is_poison")
    return out.select("ord", F.posexplode("v").alias("p", "x")).select("ord", "p", F.round("x", 6).alias("x"))


def projection_usage(s, d):
    v = _vectors(s, d)
    return attack.usage_by_lambda(v, _vector_queries(v), LAMBDAS).select("lam", F.round("usage", 6).alias("usage"))


def adaptive_lambda(s, d):
    v = _vectors(s, d)
    mean = attack.mean_vector(_vector_queries(v))
    own = v.filter("is_poison").crossJoin(F.broadcast(mean))
    sims = own.select("ord", retrieve.dot(F.col("v"), F.col("mean")).alias("sim"), retrieve.dot(F.col("v"), F.col("mean")).alias("gain"), retrieve.dot(F.col("v"), F.col("v")).alias("penalty"))
    lambdas = s.createDataFrame([(x,) for x in LAMBDAS], "lam double")
    return attack.best_lambda(sims, lambdas, 5, 0.05)


def lambda_sweep(s, d):
    """How the share of injected rows among the top 5 grows with the push along the mean query."""
    v = _vectors(s, d)
    top = attack.swept_top_k(v, _vector_queries(v), LAMBDAS, K)
    return top.groupBy("lam").agg(F.round(F.avg(F.when(F.col("is_poison"), 1.0).otherwise(0.0)), 9).alias("poison_share"), F.round(F.avg("score"), 6).alias("mean_score"))


def swap_control(s, d):
    out = attack.swapped(docs(s, d), "veteran", "apprentice", 50)
    return out.groupBy("grp", "stance").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ords"), F.countDistinct("doc_id").alias("ids"))


# selection
def _candidates(s, d):
    return selection(s, d, retrieve.fetch_size(K)).drop("rnk")


def select_vanilla(s, d):
    return selection(s, d).select("cell_id", "qid", "rnk", "doc_id", "score")


def select_group_budget(s, d):
    return select.group_budget(_candidates(s, d), ["cell_id", "qid"], K, 0.1).select("cell_id", "qid", "rnk", "doc_id", "admitted")


def select_stance_budget(s, d):
    return select.stance_budget(_candidates(s, d), ["cell_id", "qid"], K, 0.25, "stance")


def select_both_budget(s, d):
    return select.stance_budget(_candidates(s, d), ["cell_id", "qid"], K, 0.0, "both")


def select_multi_query(s, d):
    n = 5
    q = queries(s, d)
    texts, same = retrieve.distinct_texts(q)
    v = cut(select.variants(texts, n).select(F.concat_ws("#", "qid", "v").alias("qid"), "text"))
    # every (term, document) part is made once; a variant is one more column of the query matrix
    ranked = retrieve.top_by_text(docs(s, d), v, retrieve.fetch_size(K))
    ranked = ranked.select(F.split("qid", "#")[0].alias("qid"), F.split("qid", "#")[1].cast("int").alias("v"), "ord", "rnk")
    return retrieve.to_all(select.consistency(ranked, n + 1, K), same).select("qid", "rnk", "ord", "score")


def select_manifold(s, d):
    v = _vectors(s, d)
    top = retrieve.vector_top_k(v, _vector_queries(v), retrieve.fetch_size(K)).drop("rnk")
    model = select.manifold(v.filter(~F.col("is_poison")))
    return select.penalised(top.join(v.select("ord", "v"), "ord"), ["qid"], K, model).select("qid", "rnk", "ord", "score")


# set statistics
def group_profile(s, d):
    return metrics.group_profile(selection(s, d), queries(s, d), strata(s, d)).select("cell_id", "qid", "grp", "n", "n_fav", "support", F.round("share", 9).alias("share"), F.round("fav_rate", 9).alias("fav_rate"))


def corpus_fav_rate(s, d):
    return metrics.corpus_rates(docs(s, d)).select("grp", "n", F.round("fav_rate", 9).alias("fav_rate"), F.round("share", 9).alias("share"))


def corpus_group_dist(s, d):
    return metrics.corpus_distribution(docs(s, d), strata(s, d)).select("stratum", "grp", F.round("share", 9).alias("share"))


def aggregate_cells(s, d):
    return metrics.means(per_query(s, d), ["cell_id"])


def by_stratum_means(s, d):
    cells = table(s, d, "cells").select("cell_id", "attack", "poison_rate", "retriever", "backbone", "defense")
    return metrics.means(per_query(s, d).join(cells, "cell_id"), ["attack", "poison_rate", "retriever", "backbone", "defense", "stratum"])


def rolled_up(s, d):
    return metrics.rolled_up(per_query(s, d), table(s, d, "cells"))


def signed_drift(s, d):
    return metrics.signed_drift(selection(s, d), queries(s, d), strata(s, d), docs(s, d))


def overgeneralisation(s, d):
    return metrics.overgeneralisation(selection(s, d), docs(s, d), queries(s, d))


def _bm25_marked(s, d, statistic):
    """A statistic of all documents' scores for each distinct query text, given to all its queries."""
    texts, same = retrieve.distinct_texts(queries(s, d).withColumn("text", F.coalesce("text", F.lit(""))))
    scored = retrieve.bm25_texts(docs(s, d), texts).join(docs(s, d).select("ord", "is_poison"), "ord")
    return retrieve.to_all(statistic(scored, docs(s, d), texts), same)


def poison_margin(s, d):
    return _bm25_marked(s, d, lambda *x: metrics.margins(*x, K)).select("qid", "margin", "hit")


def outranked_fraction(s, d):
    return _bm25_marked(s, d, metrics.outranked).select("qid", "ord", "fraction")


def label_distribution(s, d):
    return metrics.label_distribution(per_query(s, d), ["cell_id"])


def vector_anisotropy(s, d):
    return metrics.anisotropy(_vectors(s, d))


# statistics
def _gaps(s, d):
    cells = table(s, d, "cells").select("cell_id", "attack", "defense")
    return per_query(s, d).join(cells, "cell_id")


def _by_query(s, d):
    """One value per query: its mean gap over attacked and over clean cells."""
    g = _gaps(s, d).filter(F.col("stance_gap").isNotNull())
    return g.groupBy("qid", "stratum").agg(F.round(F.avg(F.when(F.col("attack") == "clean", F.col("stance_gap"))), 9).alias("clean"), F.round(F.avg(F.when(F.col("attack") != "clean", F.col("stance_gap"))), 9).alias("attacked"))


def _diffs(s, d):
    rows = _by_query(s, d).filter(F.col("clean").isNotNull() & F.col("attacked").isNotNull()).select("stratum", "qid", (F.col("attacked") - F.col("clean")).alias("value"))
    return stats.numbered(rows, ["stratum"], ["qid"])


def bootstrap_ci(s, d):
    rows = _by_query(s, d).filter(F.col("attacked").isNotNull()).select("stratum", "qid", F.col("attacked").alias("value"))
    out = stats.bootstrap(stats.numbered(rows, ["stratum"], ["qid"]), ["stratum"], 5000, 11)
    return out.withColumn("bound", stats.equivalence_bound(F.col("low"), F.col("high")))


def paired_bootstrap(s, d):
    return stats.bootstrap(_diffs(s, d), ["stratum"], 10_000, 12)


def paired_permutation(s, d):
    return stats.sign_flip(_diffs(s, d), ["stratum"], 10_000, 13)


def two_sample_bootstrap(s, d):
    rows = _by_query(s, d)
    long = rows.select("qid", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("clean").alias("value")), F.struct(F.lit("b").alias("side"), F.col("attacked").alias("value")))).alias("x")).select("qid", "x.side", "x.value")
    return stats.two_sample(stats.numbered(long.filter(F.col("value").isNotNull()), ["side"], ["qid"]), 2000, 14)


def auc_tie_aware(s, d):
    rows = _gaps(s, d).select("stratum", F.col("stance_gap").alias("score"), F.when(F.col("attack") == "clean", 0).otherwise(1).alias("label"))
    return stats.auc(rows, ["stratum"])


def pearson_by_stratum(s, d):
    t = table(s, d, "by_stratum").select("stratum", defined(F.col("stance_gap")).alias("x"), defined(F.col("poison_share")).alias("y"))
    return stats.pearson(t, ["stratum"], "x", "y")


def nearest_rank_p90(s, d):
    rows = per_query(s, d).select("stratum", F.col("drift_tv").alias("v"))
    return stats.nearest_rank(rows, ["stratum"], "v", 0.9)


def replica_batches(s, d):
    rows = stats.batches(per_query(s, d), ["cell_id", "stratum"], "qid")
    return rows.groupBy("cell_id", "stratum", "batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("stance_gap"), 12).alias("gap"))


def monitor_scores(s, d):
    rows = stats.monitor_scores(_gaps(s, d), ["stratum", "attack"], "stance_gap")
    return rows.groupBy("stratum", "attack").agg(F.round(F.avg("off_half"), 12).alias("off_half"), F.round(F.max("deviation"), 12).alias("deviation"))


def paired_monitor(s, d):
    """|attacked - clean| of each query as a positive, a literal 0 as its negative: any metric that
    moves at all scores high here, so this is a diagnostic only."""
    rows = _by_query(s, d).filter(F.col("clean").isNotNull() & F.col("attacked").isNotNull())
    pos = rows.select(F.round(F.abs(F.col("attacked") - F.col("clean")), 9).alias("score"), F.lit(1).alias("label"))
    neg = rows.select(F.lit(0.0).alias("score"), F.lit(0).alias("label"))
    return stats.auc(pos.unionByName(neg).withColumn("monitor", F.lit("paired")), ["monitor"])


def level_spread(s, d):
    return stats.spread(per_query(s, d), ["stratum"], "poison_share", "stance_gap")


def inertness(s, d):
    t = table(s, d, "by_stratum")
    keys = ["run_tag", "attack", "poison_rate", "retriever", "backbone", "stratum"]
    clean = t.select(*keys, "defense", *[defined(F.col(m)).alias(m) for m in MEASURES])
    one = lambda name: clean.filter(F.col("defense") == name).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in MEASURES])
    out = stats.largest_changes(one("vanilla"), one("repr_group"), keys, MEASURES)
    return out.withColumn("verdict", stats.verdict(F.col("worst")))


def top_agreement(s, d):
    return stats.agreement(bm25_topk(s, d), hash_dense_topk(s, d), "qid", "ord")


def counter_draws(s, d):
    q = queries(s, d)
    return q.select("qid", counter_random(F.lit(1), F.col("qid"), F.col("qord")).alias("h"), mixed(counter_random(F.lit(1), F.col("qid"), F.col("qord"))).alias("m"))


# generation
def _answers(s, d):
    return generation.latest(table(s, d, "answers"))


def collected_contexts(s, d):
    c = table(s, d, "cells")
    chosen = selection(s, d).join(docs(s, d).select("ord", "text"), "ord", "left")
    first = lambda cond, where: chosen.join(c.filter(where).agg(F.min("cell_id").alias("cell_id")), "cell_id").select("qid", "rnk", "doc_id", "text", "is_poison")
    out = generation.contexts({"clean": first("clean", F.col("attack") == "clean"), "poisoned": first("poisoned", (F.col("attack") != "clean") & (F.col("defense") == "vanilla")), "r1only": first("r1only", F.col("defense") == "repr_group"), "r2both": first("r2both", F.col("defense") == "repr_both")})
    return out.select("cond", "qid", F.array_join("context_ids", ",").alias("ids"), "n_poison", F.length(T.format_context(F.col("texts"))).alias("size"))


def limited_answers(s, d):
    """The first two answers of each condition and query, by id."""
    order = Window.partitionBy("cond", "qid").orderBy("answer_id")  # a limit of 2 per key is pushed below the shuffle
    return _answers(s, d).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= 2).select("cond", "qid", "answer_id")


def favourable_rates(s, d):
    return generation.favourable_rate(_answers(s, d).filter(generation.usable(F.col("error"))), ["generator", "cond", "stratum"])


def strata_means(s, d):
    return generation.mean_over_strata(_answers(s, d), ["generator", "cond"])


def _choices(s, d):
    a = _answers(s, d).withColumn("grp", F.lit("g"))
    a = generation.option_order(a, 3)
    choice = F.when(F.col("leaning") != 0, F.when((F.col("leaning") > 0) == F.col("fav_is_a"), F.lit("A")).otherwise(F.lit("B")))
    p = (F.col("answer_id") % 100) / 100
    return a.select("answer_id", "generator", "cond", "qid", "fav_is_a", choice.alias("choice"), p.alias("p_fav"), (1 - p).alias("p_unfav"))


def forced_choice_summary(s, d):
    return generation.forced_choice_summary(_choices(s, d))


def stance_pairs(s, d):
    a = _answers(s, d).select("answer_id", "stratum", "answer")
    pairs = generation.pair_expansion(a, strata(s, d))
    scored = pairs.select("answer_id", "grp", "side", (counter_random(F.col("answer_id"), F.col("grp"), F.col("side")) % 1000 / 1000).alias("p"))
    return generation.gaps(generation.stances(scored)).select("answer_id", F.round("gap", 6).alias("gap"))


def condition_summary(s, d):
    """Scores are stand-ins by counter hash, as in ``stance_pairs``."""
    a = _answers(s, d)
    score = lambda *parts: counter_random(*[F.col(c) for c in parts]) % 1000 / 1000
    pairs = generation.pair_expansion(a.select("answer_id", "stratum", "answer"), strata(s, d)).join(a.select("answer_id", "stratum"), "answer_id")
    pairs = pairs.join(strata(s, d).select("stratum", "grp", "gpos"), ["stratum", "grp"])
    stance = generation.stances(pairs.select("answer_id", F.col("gpos").alias("grp"), "side", score("answer_id", "grp", "side").alias("p"))).withColumnRenamed("grp", "gpos")
    passages = generation.passage_expansion(a, docs(s, d)).select("answer_id", "pos", score("answer_id", "pos", "premise").alias("p"))
    return generation.summarise_condition(a, stance, passages, ["generator", "cond"], seed=15)


def context_sensitivity(s, d):
    return generation.changed(_answers(s, d), "clean")


def identical_answers(s, d):
    return generation.always_same(_answers(s, d))


# reports
def backbone_pivot(s, d):
    t = table(s, d, "by_stratum").select("attack", "defense", "retriever", defined(F.col("poison_in_topk")).alias("v"))
    return reports.pivot_report(t, ["attack", "defense"], "retriever", ["bm25", "dense", "st", "splade", "hybrid"], "v")


def lambda_collapse(s, d):
    c = table(s, d, "cells").select("cell_id", "defense", F.when(F.col("lam").isNull(), "none").otherwise(F.format_string("%.2f", "lam")).alias("lam"))
    rows = per_query(s, d).join(c, "cell_id")
    return reports.pivot_report(rows, ["defense"], "lam", ["none", *[f"{x:.2f}" for x in LAMBDAS]], "poison_in_topk").toDF("defense", "lam_none", *[f"lam_{int(x * 100)}" for x in LAMBDAS])


def baseline_delta(s, d):
    t = table(s, d, "by_stratum").groupBy("retriever", "stratum", "defense").agg(F.round(F.avg(defined(F.col("stance_gap"))), 12).alias("gap"))
    return reports.against_baseline(t, ["retriever", "stratum"], "defense", "vanilla", "gap")


def cell_lookup(s, d):
    want = reports.same_cell({"attack": "template", "backbone": None, "poison_rate": 0.02})
    return table(s, d, "by_stratum").filter(want).groupBy("retriever", "defense").agg(F.count(F.lit(1)).alias("n"))


def partial_cells(s, d):
    return reports.partial_cells(per_query(s, d), ["cell_id"])


def label_audit(s, d):
    return reports.label_audit(table(s, d, "generators"), "generator", {"api": "ChatClient", "local": "LocalGenerator"})


def figure_data(s, d):
    return reports.as_json(aggregate_cells(s, d).select("cell_id", "n_queries", "n_valid_stance_gap"), ["cell_id"])


def first_per_stratum(s, d):
    """The first four queries of each stratum, as a quick run takes them."""
    return stats.numbered(queries(s, d), ["stratum"], ["qord"]).filter(F.col("i") < 4).select("stratum", "qid")


def number_provenance(s, d):
    t = table(s, d, "by_stratum").select("run_tag", "retriever", defined(F.col("mean_score")).alias("m")).filter("m is not null")
    series = s.createDataFrame([(0.25,), (1.5,), (2.234,)], "x double")
    return reports.close_values(t, "m", series).groupBy("run_tag", "x").agg(F.count(F.lit(1)).alias("n"))


def choice_agreement(s, d):
    return generation.agreement(_choices(s, d), ["generator", "cond"])


def commitment(s, d):
    """Scores are stand-ins by counter hash, as in ``stance_pairs``."""
    a = _answers(s, d)
    pairs = generation.pair_expansion(a.select("answer_id", "stratum", "answer"), strata(s, d))
    scored = pairs.select("answer_id", "grp", "side", (counter_random(F.col("answer_id"), F.col("grp"), F.col("side")) % 1000 / 1000).alias("p"))
    return generation.commitment_diagnostic(scored, a, ["generator", "cond"])


def scorer_calibration(s, d):
    """Two directions and four styles of asking; scores are stand-ins by counter hash."""
    ways = s.createDataFrame([(x, y) for x in ("answer first", "statement first") for y in range(4)], "direction string, style int")
    a = _answers(s, d).filter(F.col("answer").isNotNull()).select("answer_id", "leaning").crossJoin(F.broadcast(ways))
    return generation.calibration(a.select("direction", "style", "leaning", (counter_random(F.col("answer_id"), F.col("direction"), F.col("style")) % 1000 / 1000).alias("p")))


def context_stance(s, d):
    """The stance of each selection's context block towards the groups of its query's stratum, and
    their gap; scores are stand-ins by counter hash."""
    keys = selection(s, d).select("cell_id", "qid").distinct().join(retrieve.small_side(queries(s, d).select("qid", "stratum")), "qid").join(F.broadcast(strata(s, d).select("stratum", "grp")), "stratum")
    p = lambda side: counter_random(F.col("cell_id"), F.col("qid"), F.col("grp"), F.lit(side)) % 1000 / 1000
    stance = keys.select("cell_id", "qid", (p("fav") - p("unfav")).alias("stance"))
    return stance.groupBy("cell_id", "qid").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.when(F.count(F.lit(1)) >= 2, F.max("stance") - F.min("stance")), 6).alias("gap"))


def relevance_floor(s, d):
    """Undefended rankings above a floor: how many rows of each selection are left."""
    rows = select.vanilla(select.above(_candidates(s, d), 0.5), ["cell_id", "qid"], K)
    return rows.groupBy("cell_id", "qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))


def weighted_group_budget(s, d):
    """Group mode with given reference shares in place of uniform ones."""
    shares = {"veteran": 0.6, "apprentice": 0.4, "remote": 0.3, "onsite": 0.7}
    return select.group_budget(_candidates(s, d), ["cell_id", "qid"], K, 0.1, shares).select("cell_id", "qid", "rnk", "doc_id", "admitted")


def epsilon_theory(s, d):
    """Each epsilon's mean drift against the undefended one of its retriever and stratum, and whether
    it stays within epsilon."""
    t = table(s, d, "by_stratum").select("retriever", "stratum", "defense", "epsilon", defined(F.col("drift_tv")).alias("v"))
    base = t.filter(F.col("defense") == "vanilla").groupBy(F.col("retriever").alias("r"), F.col("stratum").alias("st")).agg(F.round(F.avg("v"), 12).alias("base"))
    own = t.filter(F.col("epsilon").isNotNull()).groupBy("retriever", "stratum", "defense", "epsilon").agg(F.count("v").alias("n"), F.round(F.avg("v"), 12).alias("drift"))
    rows = own.join(F.broadcast(base), F.col("retriever").eqNullSafe(F.col("r")) & F.col("stratum").eqNullSafe(F.col("st")), "left")  # a row per retriever and stratum
    return rows.select("retriever", "stratum", "defense", "epsilon", "n", "drift", F.round(F.col("drift") - F.col("base"), 12).alias("delta"), (F.col("drift") <= F.col("epsilon") + 1e-9).alias("within"))


def scale_check(s, d):
    keys = ["attack", "poison_rate", "retriever", "backbone", "defense", "epsilon"]
    return reports.matched_runs(table(s, d, "by_stratum"), table(s, d, "cells"), keys)


def generation_report(s, d):
    """Favourable rates of each generator, one column per condition."""
    rates = generation.mean_over_strata(_answers(s, d), ["generator", "cond"]).select("generator", "cond", "rate")
    return reports.pivot_report(rates, ["generator"], "cond", ["clean", "poisoned", "r1only", "r2both"], "rate")


def injection_noop(s, d):
    """Appending injected passages changes no clean one."""
    clean = docs(s, d).filter(~F.col("is_poison"))
    after = attack.appended(clean, attack.injected(docs(s, d), strata(s, d), 20))
    return reports.unchanged(clean, after, "ord", ["doc_id", "text", "grp", "stance"])


def effective_dimension(s, d):
    """exp of the entropy of the eigenvalues of all vectors' moment matrix, centred."""
    return metrics.effective_dimensions(_vectors(s, d))


def experiment_grid(s, d):
    """The whole grid over the controlled corpus; the tables of the folder are not read."""
    return sweep.controlled(s)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, fnv_hash, strip_filler, align_prefix, prompts, parsed_choices, inverted, bm25_index_stats, bm25_topk, hash_embed, hash_dense_topk, sparse_dot_topk,
        embedding_topk, poison_budget, injected_passages, corpus_union_ties, subspace_project, projection_usage, adaptive_lambda, lambda_sweep, swap_control, select_vanilla,
        select_group_budget, select_stance_budget, select_both_budget, select_multi_query, select_manifold, group_profile, corpus_fav_rate, corpus_group_dist,
        aggregate_cells, by_stratum_means, rolled_up, signed_drift, overgeneralisation, poison_margin, outranked_fraction, label_distribution, vector_anisotropy,
        bootstrap_ci, paired_bootstrap, paired_permutation, two_sample_bootstrap, auc_tie_aware, pearson_by_stratum, nearest_rank_p90, replica_batches, monitor_scores,
        paired_monitor, level_spread, inertness, top_agreement, counter_draws, collected_contexts, limited_answers, favourable_rates, strata_means,
        forced_choice_summary, stance_pairs, condition_summary, context_sensitivity, identical_answers, backbone_pivot, lambda_collapse, baseline_delta, cell_lookup, number_provenance,
        partial_cells, label_audit, figure_data, first_per_stratum, experiment_grid,
        choice_agreement, commitment, scorer_calibration, context_stance, relevance_floor, weighted_group_budget, epsilon_theory, scale_check, generation_report,
        injection_noop, effective_dimension,
    )
} | {
    "drift_tv": _metric("drift_tv"), "drift_js": _metric("drift_js"), "stance_shift": _metric("stance_shift"), "stance_div": _metric("stance_div"),
    "stance_onesided": _metric("stance_onesided"), "stance_gap": _metric("stance_gap"), "attack_success": _metric("poison_in_topk", "poison_share"),
    "in_pool_rate": _metric("in_pool_rate", "mean_score"),
}
