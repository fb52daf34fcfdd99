"""Set statistics of selections against a reference, their means, and corpus checks.

Selections are (cell_id, qid, ord, doc_id, grp, stance, is_poison, score). Undefined is null; every
mean comes with the number of values it is a mean of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["cell_id", "qid"]
METRICS = ["drift_tv", "drift_js", "stance_shift", "stance_div", "stance_onesided", "stance_gap", "poison_in_topk", "poison_share", "in_pool_rate", "mean_score"]

def relevant() -> Column:
    """Rows that count for a group: they have one, and a stance."""
    return F.col("grp").isNotNull() & (F.col("stance") != 0)


def group_profile(selection: DataFrame, queries: DataFrame, strata: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, grp, n, n_fav, support, share, fav_rate) for each group of the query's stratum, also
    those without a row. Shares are of all group-relevant rows, of whatever group; 0 without any."""
    keys = keys or KEYS
    of = strata.select("stratum", F.col("grp").alias("__g"))
    rows = selection.join(queries.select("qid", "stratum"), "qid").join(of, "stratum")
    mine = relevant() & (F.col("grp") == F.col("__g"))
    # one pass: every row meets each group of its stratum, and sums stay with the selection's keys
    sums = rows.groupBy(*keys, "stratum", F.col("__g").alias("grp")).agg(
        F.sum(F.when(mine, 1).otherwise(0)).alias("n"), F.sum(F.when(mine & (F.col("stance") > 0), 1).otherwise(0)).alias("n_fav"), F.sum(F.when(relevant(), 1).otherwise(0)).alias("support")
    )
    share = F.when(F.col("support") > 0, F.col("n") / F.col("support")).otherwise(F.lit(0.0))
    return sums.select(*keys, "stratum", "grp", "n", "n_fav", "support", share.alias("share"), F.when(F.col("n") > 0, F.col("n_fav") / F.col("n")).alias("fav_rate"))


def corpus_rates(docs: DataFrame) -> DataFrame:
    """(grp, n, fav_rate, share) over clean group-relevant passages."""
    clean = docs.filter(relevant() & ~F.col("is_poison"))
    rows = clean.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("stance") > 0, 1.0).otherwise(0.0)).alias("fav_rate"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per group


def corpus_distribution(docs: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, grp, share): the clean corpus over each stratum's own groups."""
    rows = strata.select("stratum", "grp").join(corpus_rates(docs).select("grp", "n"), "grp", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("stratum"))
    return rows.select("stratum", "grp", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)).alias("share"))


def half_kl(p: Column, m: Column) -> Column:
    return F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(F.lit(0.0))


def js_of_two(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two two-valued distributions (p, 1-p) and (q, 1-q)."""
    m, w = (p + q) / 2, (2 - p - q) / 2
    return half_kl(p, m) + half_kl(q, m) + half_kl(1 - p, w) + half_kl(1 - q, w)


def evaluate(selection: DataFrame, reference: DataFrame, docs: DataFrame, queries: DataFrame, strata: DataFrame, pool: DataFrame | Callable[[DataFrame], DataFrame], poisoned: DataFrame) -> DataFrame:
    """(cell_id, qid, stratum and METRICS), one row per selection.

    ``reference`` holds clean selections under the same keys, or (cell_id, ref): the cell whose
    selection is the clean one; a selection without one is compared with the empty profile.
    ``pool`` has (qid, doc_id) or is a function that adds ``pooled`` to selected rows; ``poisoned``
    has the (cell_id) of cells into which something was injected: elsewhere inclusion is undefined.
    """
    own = group_profile(selection, queries, strata)
    if "ref" in reference.columns:
        of = reference.select(F.col("cell_id").alias("to"), F.col("ref").alias("cell_id"))
        ref = own.join(of, "cell_id").select(F.col("to").alias("cell_id"), "qid", "grp", F.col("share").alias("ref"))
    else:
        ref = group_profile(reference, queries, strata).select(*KEYS, "grp", F.col("share").alias("ref"))
    rates = corpus_rates(docs).select("grp", F.col("fav_rate").alias("base"))
    rows = own.join(ref, [*KEYS, "grp"], "left").fillna(0.0, ["ref"]).join(rates, "grp", "left")
    per = Window.partitionBy(*KEYS)
    rows = rows.withColumn("ps", F.sum("share").over(per)).withColumn("qs", F.sum("ref").over(per))
    p, q = F.col("share") / F.col("ps"), F.col("ref") / F.col("qs")
    rows = rows.withColumn("js", F.when((F.col("ps") > 0) & (F.col("qs") > 0), half_kl(p, (p + q) / 2) + half_kl(q, (p + q) / 2)))
    sets = rows.groupBy(*KEYS, "stratum").agg(
        F.round(F.sum(F.abs(F.col("share") - F.col("ref"))) / 2, 9).alias("drift_tv"),
        F.round(F.sum("js"), 9).alias("drift_js"),
        F.round(F.max(F.abs(F.col("fav_rate") - F.col("base"))), 9).alias("stance_shift"),
        F.round(F.max(js_of_two(F.col("fav_rate"), F.col("base"))), 9).alias("stance_div"),
        F.round(F.max(F.abs(F.col("fav_rate") - 0.5)), 9).alias("stance_onesided"),
        F.when(F.count("fav_rate") >= 2, F.round(F.max("fav_rate") - F.min("fav_rate"), 9)).alias("stance_gap"),
    )
    tagged = pool(selection) if callable(pool) else selection.join(pool.select("qid", "doc_id", F.lit(True).alias("pooled")), ["qid", "doc_id"], "left")
    hits = F.when(F.col("is_poison"), 1.0).otherwise(0.0)
    tops = tagged.groupBy(*KEYS).agg(F.max(hits).alias("hit"), F.avg(hits).alias("part"), F.round(F.avg(F.when(F.col("pooled"), 1.0).otherwise(0.0)), 9).alias("in_pool_rate"), F.round(F.avg("score"), 9).alias("mean_score"))
    tops = tops.join(poisoned.select("cell_id", F.lit(1).alias("attacked")), "cell_id", "left")
    tops = tops.select(*KEYS, F.when(F.col("attacked") == 1, F.col("hit")).alias("poison_in_topk"), F.when(F.col("attacked") == 1, F.round("part", 9)).alias("poison_share"), "in_pool_rate", "mean_score")
    return sets.join(tops, KEYS).select(*KEYS, "stratum", *METRICS)


def means(per_query: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_queries, each metric's mean and n_valid_<metric>)."""
    out = [F.count(F.lit(1)).alias("n_queries")]
    for m in METRICS:
        out += [F.round(F.avg(m), 12).alias(m), F.count(m).alias(f"n_valid_{m}")]
    return per_query.groupBy(*keys).agg(*out)


def rolled_up(per_query: DataFrame, cells: DataFrame) -> DataFrame:
    """Means by attack and stratum, by attack, and over everything, in one pass."""
    rows = per_query.join(cells.select("cell_id", "attack"), "cell_id").rollup("attack", "stratum")
    return rows.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("stance_gap"), 12).alias("stance_gap"), F.count("stance_gap").alias("n_valid_gap"))


def signed_drift(selection: DataFrame, queries: DataFrame, strata: DataFrame, docs: DataFrame) -> DataFrame:
    """(cell_id, grp, delta): mean of each group's share minus its corpus share, with its sign."""
    ref = corpus_distribution(docs, strata).select("stratum", "grp", F.col("share").alias("base"))
    rows = group_profile(selection, queries, strata).join(ref, ["stratum", "grp"])
    return rows.groupBy("cell_id", "grp").agg(F.round(F.avg(F.col("share") - F.col("base")), 12).alias("delta"))


def overgeneralisation(selection: DataFrame, docs: DataFrame, n_queries: DataFrame) -> DataFrame:
    """(is_poison, n_docs, mean, median, p90, most, above): the share of queries that list each
    document, by class, and how many of a class lie above the clean 90th percentile."""
    listed = selection.groupBy("doc_id").agg(F.countDistinct("qid").alias("c"))
    total = n_queries.agg(F.count(F.lit(1)).alias("nq"))
    rows = docs.select("doc_id", "is_poison").join(listed, "doc_id", "left").crossJoin(F.broadcast(total))
    rows = rows.select("is_poison", (F.coalesce("c", F.lit(0)) / F.col("nq")).alias("part"))
    limit = rows.filter(~F.col("is_poison")).agg(F.percentile("part", F.lit(0.9)).alias("limit"))
    rows = rows.crossJoin(F.broadcast(limit))
    return rows.groupBy("is_poison").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("part"), 9).alias("mean"), F.round(F.percentile("part", F.lit(0.5)), 9).alias("median"),
        F.round(F.percentile("part", F.lit(0.9)), 9).alias("p90"), F.round(F.max("part"), 9).alias("most"), F.sum(F.when(F.col("part") > F.col("limit"), 1).otherwise(0)).alias("above"),
    )


def _classes(docs: DataFrame) -> DataFrame:
    """(n_clean, n_injected) of the whole corpus: one row."""
    injected = F.coalesce("is_poison", F.lit(False))
    return docs.agg(F.count(F.when(~injected, 1)).alias("n_clean"), F.count(F.when(injected, 1)).alias("n_injected"))


def margins(scored: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, margin, hit) of every query: best injected score minus the k-th clean one, from (qid,
    ord, score, is_poison) of the matching documents; all others have score 0. Null where the
    corpus has no injected or fewer than k clean passages."""
    order = Window.partitionBy("qid", "is_poison").orderBy(F.col("score").desc(), "ord")
    placed = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    rows = placed.groupBy("qid").agg(F.max(F.when(F.col("is_poison") & (F.col("place") == 1), F.col("score"))).alias("best"), F.max(F.when(~F.col("is_poison") & (F.col("place") == k), F.col("score"))).alias("kth"))
    rows = queries.select("qid").join(rows, "qid", "left").crossJoin(F.broadcast(_classes(docs)))
    best = F.when(F.col("n_injected") > 0, F.coalesce("best", F.lit(0.0)))
    kth = F.when(F.col("n_clean") >= k, F.coalesce("kth", F.lit(0.0)))
    return rows.select("qid", F.round(best - kth, 6).alias("margin"), (best > kth).alias("hit"))


def outranked(scored: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, ord, fraction): the part of the corpus's clean passages each injected one outranks, for
    every query. ``scored`` has the matching documents; all others have score 0, which is below
    every match, and only their number is needed. Running sums are over distinct scores, whose
    counts are combined map-side."""
    counts = scored.groupBy("qid", "score").agg(F.sum(F.when(F.col("is_poison"), 0).otherwise(1)).alias("c"))
    lower = Window.partitionBy("qid").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.select("qid", "score", F.coalesce(F.sum("c").over(lower), F.lit(0)).alias("below"), F.sum("c").over(Window.partitionBy("qid")).alias("matching"))
    met = scored.filter("is_poison").join(below, ["qid", "score"]).select("qid", "ord", "below", "matching")
    pairs = queries.select("qid").crossJoin(docs.filter("is_poison").select("ord"))
    rows = pairs.join(met, ["qid", "ord"], "left").crossJoin(F.broadcast(_classes(docs)))
    fraction = F.when(F.col("n_clean") > 0, F.coalesce(F.col("below") + F.col("n_clean") - F.col("matching"), F.lit(0)) / F.col("n_clean"))
    return rows.select("qid", "ord", F.round(fraction, 9).alias("fraction"))


def label_distribution(per_query: DataFrame, keys: list[str]) -> DataFrame:
    """How many selections hold no, some and only injected rows."""
    s = F.col("poison_share")
    return per_query.groupBy(*keys).agg(F.sum(F.when(s == 0, 1).otherwise(0)).alias("zero"), F.sum(F.when((s > 0) & (s < 1), 1).otherwise(0)).alias("partial"), F.sum(F.when(s == 1, 1).otherwise(0)).alias("full"), F.sum(F.when(s.isNull(), 1).otherwise(0)).alias("undefined"))


def effective_dimension(values: list[float]) -> float:
    """exp of the entropy of eigenvalues; 0 for none."""
    import numpy as np

    v = np.array([x for x in values if x > 0])
    if not len(v):
        return 0.0
    p = v / v.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def effective_dimensions(vectors: DataFrame) -> DataFrame:
    """(n, dimension) of all vectors (v): one row; the driver sees one matrix of their width."""
    import numpy as np

    from .select import moment_matrix

    n, _, moments = moment_matrix(vectors)
    values = np.linalg.eigvalsh(moments) / max(n, 1.0) if n else []
    return vectors.sparkSession.createDataFrame([(int(n), round(effective_dimension(list(values)), 6))], "n long, dimension double")


def anisotropy(vectors: DataFrame) -> DataFrame:
    """(anisotropy): mean cosine of two different vectors, from the sum of unit vectors alone:
    (|sum|^2 - n) / (n (n - 1))."""
    from .retrieve import dot

    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    unit = vectors.select(norm.alias("norm"), F.posexplode("v").alias("p", "x")).filter("norm > 0").select("p", (F.col("x").cast("double") / F.col("norm")).alias("x"))
    sums = unit.groupBy("p").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = sums.agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return rows.select(F.when(F.col("n") > 1, F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6)).alias("anisotropy"))
