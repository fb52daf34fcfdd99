"""Top N items within every group, with histogram thresholds ahead of the exact ranking.

A narrow histogram (group, score bin) is aggregated map-side first. Each bin carries a bitmap of
hashed item ids, so the OR of the bins from the top down has at most as many set bits as there are
distinct items in them. The first bin at which that OR reaches N bits is a threshold that provably
leaves at least N distinct items, also when items are repeated. Rows below it never reach the
ranking shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score bins per doubling of the score.
BINS_PER_DOUBLING = 4
#: Groups that would lose fewer rows than this keep all of them: a threshold costs more than it saves.
LEAST_SAVING = 32
#: A thresholded group's rows are spread over so many tasks.
SALTS = 16


def score_bin(score: Column) -> Column:
    """A bin number that never decreases with the score; zero has its own bin."""
    size = F.floor((F.least(F.log2(F.abs(score)), F.lit(1100.0)) + 1080) * BINS_PER_DOUBLING).cast("int") + 1
    return F.when(score == 0, F.lit(0)).when(score > 0, size).otherwise(-size)


def thresholds(rows: DataFrame, keys: list[str], item: str, bin_column: str, n: int) -> DataFrame:
    """(keys, floor_bin) of the groups that lose at least ``LEAST_SAVING`` rows below floor_bin."""
    words = max(1, math.ceil(n / 16))
    slot = F.pmod(F.xxhash64(item), F.lit(64 * words))
    masks = [F.bit_or(F.when(F.floor(slot / 64) == w, F.expr("shiftleft(1L, cast(__slot % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"__m{w}") for w in range(words)]
    histogram = rows.withColumn("__slot", slot).groupBy(*keys, bin_column).agg(F.count(F.lit(1)).alias("__n"), *masks)
    down = Window.partitionBy(*keys).orderBy(F.col(bin_column).desc())
    seen = sum((F.bit_count(F.bit_or(f"__m{w}").over(down)) for w in range(words)), F.lit(0))
    above = F.sum("__n").over(down)
    every = F.sum("__n").over(Window.partitionBy(*keys))
    return (
        histogram.select(*keys, F.col(bin_column).alias("floor_bin"), seen.alias("__seen"), above.alias("__above"), every.alias("__all"))
        .filter(F.col("__seen") >= n)
        .groupBy(*keys)
        .agg(F.max("floor_bin").alias("floor_bin"), F.min("__above").alias("__above"), F.max("__all").alias("__all"))
        .filter(F.col("__all") - F.col("__above") >= LEAST_SAVING)
        .select(*keys, "floor_bin")
    )


def top_n(df: DataFrame, keys: list[str], item: str, score: str, tie: str, n: int = 5) -> DataFrame:
    """The ``n`` best items of each group: (keys, item, tie, score, position).

    An item counts once, with its highest score and its smallest ``tie`` value. Equal scores
    (0.0 equals -0.0) are ordered by ``tie`` ascending with null last, then by item. Rows whose
    score is null or NaN, or whose item is null, never count; infinite scores do. A null group
    key is a group of its own. Other columns are ignored; an empty table gives no rows; ``n`` of
    0 or less gives none.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    value = F.col(score).cast("double")
    rows = df.filter(value.isNotNull() & ~F.isnan(value) & F.col(item).isNotNull()).select(
        *[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(item).alias("__item"), F.col(tie).alias("__tie"), (value + F.lit(0.0)).alias("__score")
    )
    binned = rows.withColumn("__bin", score_bin(F.col("__score")))
    floors = thresholds(binned.select(*names, "__item", "__bin"), names, "__item", "__bin", max(n, 1))
    floors = floors.select(*[F.col(a).alias(f"f{a}") for a in names], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f__salt"), "floor_bin")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__item"), F.lit(SALTS)).cast("int"))
    same = F.col("__salt") == F.col("f__salt")
    for a in names:
        same = same & F.col(a).eqNullSafe(F.col(f"f{a}"))
    kept = salted.join(floors, same, "left").filter(F.col("floor_bin").isNull() | (score_bin(F.col("__score")) >= F.col("floor_bin")))
    best = kept.groupBy(*names, "__salt", "__item").agg(F.max("__score").alias("__score"), F.min("__tie").alias("__tie"))
    order = Window.partitionBy(*names).orderBy(F.col("__score").desc(), F.col("__tie").asc_nulls_last(), F.col("__item").asc())
    ranked = best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    return ranked.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], F.col("__item").alias(item), F.col("__tie").alias(tie), F.col("__score").alias(score), "position")
