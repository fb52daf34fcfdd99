"""Resampling, ranks and comparisons.

Random draws are counter hashes (functions.numbers), so a result depends on its seed alone, not on
partitioning, and any engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import counter_draw
from ..session import cut


def numbered(values: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds i, from 0, and n per key; for groups of a size that one task can sort."""
    own = Window.partitionBy(*keys)
    return values.withColumn("i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(own))


#: Values up to which every draw gets its group's values as one broadcast array; beyond, values are
#: joined to the draws' picks in a shuffle.
FEW_VALUES = 200_000


def _arrays(values: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, vs): each group's values in the order of i, for broadcast; None if there are too many."""
    if values.limit(FEW_VALUES + 1).count() > FEW_VALUES:
        return None
    rows = F.array_sort(F.collect_list(F.struct("i", "value")))
    return F.broadcast(values.groupBy(*keys).agg(F.transform(rows, lambda r: r["value"]).alias("vs")))


def _trials(values: DataFrame, trials: int, name: str) -> DataFrame:
    spark = values.sparkSession
    return spark.range(0, trials, 1, max(1, min(trials // 500, spark.sparkContext.defaultParallelism))).withColumnRenamed("id", name)


def _mean(vs: Column, of) -> Column:
    """Mean of ``of(i)`` over the positions of an array."""
    places = F.sequence(F.lit(0), F.size(vs) - 1)
    return F.aggregate(places, F.lit(0.0), lambda s, i: s + of(i)) / F.size(vs)


def bootstrap(values: DataFrame, keys: list[str], draws: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(keys, n, mean, low, high): percentile interval of the mean of ``value``, from rows
    (keys, i, n, value), such as one value per query. Each draw takes n values by counter.

    Draws are spread over tasks and meet the values where they are: only one mean per draw is
    shuffled. Groups too large for that are joined to the picks and combined map-side.
    """
    values = cut(values.select(*keys, "i", "n", "value"))
    tail = (1 - level) / 2
    few = _arrays(values, keys)
    if few is None:
        slots = values.select(*keys, "i", "n").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        picked = slots.select(*keys, "b", F.pmod(counter_draw(seed, F.col("b"), F.col("i")), F.col("n")).alias("i"))
        means = picked.join(values.select(*keys, "i", "value"), [*keys, "i"]).groupBy(*keys, "b").agg(F.avg("value").alias("m"))
    else:
        pick = lambda i: F.get("vs", F.pmod(counter_draw(seed, F.col("b"), i), F.size("vs")).cast("int"))
        means = _trials(values, draws, "b").crossJoin(few).select(*keys, _mean(F.col("vs"), pick).alias("m"))
    ends = means.groupBy(*keys).agg(F.round(F.percentile("m", F.lit(tail)), 9).alias("low"), F.round(F.percentile("m", F.lit(1 - tail)), 9).alias("high"))
    own = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))
    return own.join(ends, keys)


def equivalence_bound(low: Column, high: Column) -> Column:
    return F.greatest(F.abs(low), F.abs(high))


def sign_flip(diffs: DataFrame, keys: list[str], trials: int, seed: int = 0) -> DataFrame:
    """(keys, n, observed, p): two-sided paired permutation test of the mean of ``value`` over rows
    (keys, i, value); p is 1 where all values are (nearly) 0. Spread over tasks as in bootstrap()."""
    diffs = cut(diffs.select(*keys, "i", "value"))
    few = _arrays(diffs, keys)
    if few is None:
        signs = diffs.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
        flip = F.pmod(counter_draw(seed, F.col("t"), F.col("i")), F.lit(2)) == 0
        means = signs.groupBy(*keys, "t").agg(F.avg(F.when(flip, F.col("value")).otherwise(-F.col("value"))).alias("m"))
    else:
        signed = lambda i: F.when(F.pmod(counter_draw(seed, F.col("t"), i), F.lit(2)) == 0, F.get("vs", i)).otherwise(-F.get("vs", i))
        means = _trials(diffs, trials, "t").crossJoin(few).select(*keys, _mean(F.col("vs"), signed).alias("m"))
    own = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("observed"), F.max(F.abs("value")).alias("largest"))
    both = means.join(own, keys)
    rows = both.groupBy(*keys, "n", "observed", "largest").agg(F.avg(F.when(F.abs("m") >= F.abs("observed") - 1e-12, 1.0).otherwise(0.0)).alias("p"))
    return rows.select(*keys, "n", F.round("observed", 9).alias("observed"), F.when(F.col("largest") <= 1e-8, F.lit(1.0)).otherwise(F.round("p", 9)).alias("p"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pos, n_neg, auc) of (keys, score, label 0/1), ties at their average rank; null
    without both labels.

    Works on counts per distinct score, so ties cost one row and a group's running sums stay small.
    """
    counts = scored.filter(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    rows = counts.withColumn("won", F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2))
    out = rows.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
    both = F.col("n_pos") * F.col("n_neg")
    return out.select(*keys, "n_pos", "n_neg", F.when(both > 0, F.round(F.col("won") / both, 9)).alias("auc"))


def pearson(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, r) over rows where both are defined; null for fewer than 3 or without variance."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return out.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("vx") > 1e-18) & (F.col("vy") > 1e-18), F.round("r", 6)).alias("r"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """(keys, n, value): the value at position min(n - 1, floor(p n)) in ascending order."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = F.least(F.col("n") - 1, F.floor(p * F.col("n")))
    return placed.filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*keys, "n", F.col(value).alias("value"))


def batches(per_query: DataFrame, keys: list[str], order: str, parts: int = 12, least: int = 3) -> DataFrame:
    """Adds batch: rows of each key, in order, in chunks of max(1, n // parts); smaller chunks than
    ``least`` are dropped."""
    rows = numbered(per_query, keys, [order])
    rows = rows.withColumn("batch", F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.col("n") / parts))))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "batch"))
    return rows.withColumn("__size", size).filter(F.col("__size") >= least).drop("i", "n", "__size")


def monitor_scores(rows: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Adds off_half = |gap - 0.5| and deviation = |gap - mean of the key|."""
    means = rows.groupBy(*keys).agg(F.avg(gap).alias("__mean"))
    out = rows.join(means, keys).withColumn("off_half", F.abs(F.col(gap) - 0.5))
    return out.withColumn("deviation", F.abs(F.col(gap) - F.col("__mean"))).drop("__mean")


def spread(rows: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """(keys, levels, spread): largest minus smallest mean of ``value`` over levels rounded to 0.1."""
    means = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.round(level, 1).alias("level")).agg(F.avg(value).alias("m"))
    return means.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels"), F.round(F.max("m") - F.min("m"), 12).alias("spread"))


def verdict(difference: Column) -> Column:
    """Up to 0.15 the same, up to 0.30 similar, else different."""
    return F.when(F.abs(difference) <= 0.15, F.lit("same")).when(F.abs(difference) <= 0.30, F.lit("similar")).otherwise(F.lit("different"))


def largest_changes(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(metric, n, worst): largest absolute difference of each metric over rows with equal keys,
    nulls equal to nulls."""
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"a.{m}") - F.col(f"b.{m}")).alias("d")) for m in metrics])).alias("p")
    return a.join(b, on).select(pairs).groupBy("p.metric").agg(F.count("p.d").alias("n"), F.round(F.max("p.d"), 12).alias("worst"))


def agreement(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """(n, same): keys in both, and those with equal sets of items."""
    a = left.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("x"))
    b = right.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("y"))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("x") == F.col("y"), 1).otherwise(0)).alias("same"))


def two_sample(values: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(n_a, n_b, difference, low, high) of the means of sides 'a' and 'b' of (side, i, n, value),
    from independent draws; ends are the sorted draws at floor(0.025 d) and floor(0.975 d)."""
    values = cut(values.select("side", "i", "n", "value"))
    place = F.when(F.col("side") == "b", 1).otherwise(0)
    few = _arrays(values, ["side"])
    if few is None:
        slots = values.select("side", "i", "n").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        picked = slots.select("side", "b", F.pmod(counter_draw(seed, place, F.col("b"), F.col("i")), F.col("n")).alias("i"))
        one = picked.join(values.select("side", "i", "value"), ["side", "i"]).groupBy("side", "b").agg(F.avg("value").alias("m"))
    else:
        pick = lambda i: F.get("vs", F.pmod(counter_draw(seed, place, F.col("b"), i), F.size("vs")).cast("int"))
        one = _trials(values, draws, "b").crossJoin(few).select("side", "b", _mean(F.col("vs"), pick).alias("m"))
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("m")))
    means = one.groupBy("b").agg((side("b") - side("a")).alias("m"))
    ends = means.agg(F.sort_array(F.collect_list("m")).alias("ms"))  # one number per draw
    low, high = int(0.025 * draws), int(0.975 * draws)
    own = values.agg(F.count(F.when(F.col("side") == "a", 1)).alias("n_a"), F.count(F.when(F.col("side") == "b", 1)).alias("n_b"), (F.avg(F.when(F.col("side") == "b", F.col("value"))) - F.avg(F.when(F.col("side") == "a", F.col("value")))).alias("d"))
    return own.crossJoin(F.broadcast(ends)).select("n_a", "n_b", F.round("d", 9).alias("difference"), F.round(F.try_element_at("ms", F.lit(low + 1)), 9).alias("low"), F.round(F.try_element_at("ms", F.lit(high + 1)), 9).alias("high"))
