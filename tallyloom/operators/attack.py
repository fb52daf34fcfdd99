"""Injection of passages, perturbation of vectors and controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import counter_random
from ..functions.text import align_words, strip_filler
from .ranks import place
from .retrieve import dot, top_k, vector_top_k


def budget(rate: Column, n_docs: Column) -> Column:
    """Passages per stratum at a rate of the corpus; halves round to even, at least one."""
    return F.greatest(F.lit(1), F.bround(rate * n_docs, 0).cast("int"))


def bound(epsilon: Column, size: Column) -> Column:
    """How many passages it takes to exceed a budget of epsilon in a group of a size."""
    return F.ceil(epsilon * size) + 1


def injected(docs: DataFrame, strata: DataFrame, n: int, seed: int = 0, strength: float = 1.0, graded: bool = False) -> DataFrame:
    """(stratum, i, doc_id, text, grp, stance, is_poison): n passages per stratum.

    Even i favour the stratum's first group, odd ones disfavour its second. The base text is drawn
    among all passages of that group, whatever their stance, by a counter hash; its filler gives way
    to alignment words, all of them or, graded, a growing number. Groups without passages have none.
    """
    groups = strata.select("stratum", F.col("gpos").alias("side"), "grp")
    pool = docs.filter(F.col("grp").isNotNull() & F.col("text").isNotNull() & ~F.col("is_poison")).select("grp", "ord", "text")
    sizes = pool.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    wanted = groups.join(sizes, "grp").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(F.col("i") % 2 == F.col("side"))
    wanted = wanted.withColumn("pick", (counter_random(F.lit(seed), F.col("stratum"), F.col("i")) % F.col("size") + 1).cast("int"))
    drawn = wanted.join(place(pool, ["grp"], "ord", "pick"), ["grp", "pick"])
    words = align_words(F.col("i"), F.lit(n), strength) if graded else align_words(F.lit(1), F.lit(1), 1.0)
    return drawn.select(
        "stratum", "i", F.format_string("POISON-%s-%04d", "stratum", "i").alias("doc_id"), F.concat_ws(" ", strip_filler(F.col("text")), words).alias("text"),
        "grp", F.when(F.col("side") == 0, 1).otherwise(-1).alias("stance"), F.lit(True).alias("is_poison"),
    )


def appended(clean: DataFrame, poison: DataFrame) -> DataFrame:
    """The clean corpus followed by the injected passages, so that clean wins ties: their ``ord``
    follows the largest clean one in the order of (stratum, i)."""
    last = clean.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    sizes = poison.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))  # a row per stratum
    earlier = Window.partitionBy(F.lit(0)).orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("stratum", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    added = place(poison, ["stratum"], "i").join(starts, "stratum").crossJoin(F.broadcast(last)).withColumn("ord", F.col("last") + F.col("start") + F.col("place"))
    columns = ["ord", "doc_id", "text", "grp", "stance", "is_poison"]
    return clean.select(*columns).unionByName(added.select(*columns))


def mean_vector(vectors: DataFrame) -> DataFrame:
    """(mean): the element-wise mean of (v), one row; sums are combined map-side by position."""
    cells = vectors.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("mean"))


def project(v: Column, mean: Column, lam: Column) -> Column:
    """h + lam * (<h, q> / |q|^2) q; unchanged where |q|^2 is at most 1e-12. Not re-normalised."""
    norm = dot(mean, mean)
    step = lam * dot(v, mean) / norm
    return F.when(norm <= 1e-12, v.cast("array<double>")).otherwise(F.zip_with(v, mean, lambda x, y: x.cast("double") + step * y))


def projected(vectors: DataFrame, queries: DataFrame, lam: float) -> DataFrame:
    """(ord, v, is_poison) with the injected vectors pushed along the mean query; the mean is one
    row of fixed width."""
    mean = mean_vector(queries)
    out = vectors.crossJoin(F.broadcast(mean))
    return out.select("ord", F.when(F.col("is_poison"), project(F.col("v"), F.col("mean"), F.lit(float(lam)))).otherwise(F.col("v").cast("array<double>")).alias("v"), "is_poison")


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 1 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(dot(a, b) / norms)


def usage(before: DataFrame, after: DataFrame) -> DataFrame:
    """(usage): mean cosine of each row before and after."""
    return before.select("ord", F.col("v").alias("x")).join(after.select("ord", F.col("v").alias("y")), "ord").agg(F.avg(cosine(F.col("x"), F.col("y"))).alias("usage"))


def usage_by_lambda(vectors: DataFrame, queries: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """(lam, usage): mean cosine of the injected vectors before and after the push, for all strengths
    in one pass: with a = <h, q> / |q|^2, the pushed norm and product follow from |h|^2 and a."""
    rows = vectors.filter("is_poison").crossJoin(F.broadcast(mean_vector(queries)))
    rows = rows.select(dot(F.col("v"), F.col("v")).alias("n"), dot(F.col("v"), F.col("mean")).alias("a"), dot(F.col("mean"), F.col("mean")).alias("q"))
    rows = rows.withColumn("g", F.when(F.col("q") > 1e-12, F.col("a") * F.col("a") / F.col("q")).otherwise(0.0)).withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
    lam, n, g = F.col("lam"), F.col("n"), F.col("g")
    norms = F.sqrt(n) * F.sqrt(n + 2 * lam * g + lam * lam * g)
    return rows.groupBy("lam").agg(F.avg(F.when(norms == 0, 1.0).otherwise((n + lam * g) / norms)).alias("usage"))


def swept_top_k(vectors: DataFrame, queries: DataFrame, lambdas: Sequence[float], k: int) -> DataFrame:
    """(lam, qid, rnk, ord, is_poison, score): top-k under every strength of the push. Scores are linear
    in it: an injected vector's is <h, q> + lam a <mean, q>, so its vector gets a as one more number
    and each query one per strength; clean vectors are ranked once."""
    mean = mean_vector(queries)
    norm = dot(F.col("mean"), F.col("mean"))
    step = F.when(norm > 1e-12, dot(F.col("v"), F.col("mean")) / norm).otherwise(0.0)
    double = F.col("v").cast("array<double>")
    pushed = vectors.filter("is_poison").crossJoin(F.broadcast(mean)).select("ord", F.array_append(double, step).alias("v"))
    asked = queries.crossJoin(F.broadcast(mean)).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(len(lambdas) - 1))))
    lams = F.array(*[F.lit(float(x)) for x in lambdas])
    asked = asked.select((F.col("qid") * len(lambdas) + F.col("l")).alias("qid"), F.array_append(double, F.get(lams, F.col("l")) * dot(F.col("v"), F.col("mean"))).alias("v"))
    strength = F.get(lams, F.pmod("qid", F.lit(len(lambdas))).cast("int"))
    bad = vector_top_k(pushed, asked, k).select(strength.alias("lam"), F.floor(F.col("qid") / len(lambdas)).cast("long").alias("qid"), "ord", F.lit(True).alias("is_poison"), "score")
    good = vector_top_k(vectors.filter(~F.col("is_poison")), queries, k).select(F.explode(lams).alias("lam"), "qid", "ord", F.lit(False).alias("is_poison"), "score")
    return top_k(good.unionByName(bad), ["lam", "qid"], k)


def best_lambda(sims: DataFrame, lambdas: DataFrame, r: int, beta: float = 1.0) -> DataFrame:
    """(lam, objective) of the strongest projection: the mean of the r largest values of similarity
    minus penalty per lambda; equal objectives keep the first lambda. ``sims`` has (ord, sim, gain,
    penalty): similarity grows by lam * gain, the penalty by lam^2 * penalty."""
    grown = sims.crossJoin(F.broadcast(lambdas)).withColumn("value", F.col("sim") + F.col("lam") * F.col("gain") - beta * F.col("lam") * F.col("lam") * F.col("penalty"))
    order = Window.partitionBy("lam").orderBy(F.col("value").desc(), "ord")
    top = grown.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= r)
    means = top.groupBy("lam").agg(F.round(F.avg("value"), 9).alias("objective"))
    return means.orderBy(F.col("objective").desc(), "lam").limit(1)


def swapped(docs: DataFrame, drop: str, copy: str, n: int) -> DataFrame:
    """The composition control: the first n passages of one group give way to n copies, in turn, of
    another's; the corpus keeps its size. ``n`` is clipped to the dropped group's size."""
    placed = place(docs.filter(F.col("grp").isin(drop, copy)), ["grp"], "ord").withColumn("place", F.col("place") - 1)
    gone = placed.filter((F.col("grp") == drop) & (F.col("place") < n)).select(F.col("ord").alias("gone"), F.col("place").alias("slot"))
    kept = docs.join(gone, docs["ord"] == gone["gone"], "left_anti")
    source = placed.filter(F.col("grp") == copy)
    size = source.agg(F.count(F.lit(1)).alias("size"))
    slots = gone.crossJoin(F.broadcast(size)).filter("size > 0").withColumn("place", F.col("slot") % F.col("size"))
    copies = slots.join(source.drop("ord"), "place").select(F.col("gone").alias("ord"), *[c for c in docs.columns if c != "ord"])
    return kept.select(*docs.columns).unionByName(copies.select(*docs.columns))
