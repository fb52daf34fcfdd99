"""Mergeable percentiles with a guaranteed relative error.

A value v falls into bucket ceil(ln|v| / ln g) of its sign, g = (1 + a) / (1 - a); zero has its own
bucket. The middle of a bucket is within the factor 1 +- a of every value in it. Sketches are plain
rows (group, sign, bucket, count): counting is map-side combined, and sketches of partitions or days
merge by adding counts of equal buckets. A group has at most about 1420 / ln g buckets per sign,
whatever its number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Guaranteed relative error of a returned value.
ALPHA = 0.005
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Bucket number that stands for an infinite value.
INFINITE = 2_000_000_000


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket_sign(value: Column) -> Column:
    return F.signum(value).cast("int")


def bucket_index(value: Column, alpha: float) -> Column:
    size = F.abs(value)
    return F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(INFINITE)).otherwise(F.ceil(F.ln(size) / F.lit(math.log(gamma(alpha)))).cast("int"))


def bucket_value(sign: Column, bucket: Column, alpha: float) -> Column:
    """The value that stands for a bucket: equally far, relatively, from both of its ends."""
    g = gamma(alpha)
    # one exponent: the last bucket's upper end is beyond the largest number, its value isn't
    finite = sign * F.exp(bucket * F.lit(math.log(g)) + F.lit(math.log(2 / (1 + g))))
    return F.when(sign == 0, F.lit(0.0)).when(bucket == INFINITE, sign * F.lit(float("inf"))).otherwise(finite)


def sketch(df: DataFrame, groups: list[str], metrics: list[str], alpha: float = ALPHA) -> DataFrame:
    """(groups, metric, sign, bucket, n): one row per filled bucket.

    Null and NaN values are undefined and not counted; infinite ones are counted at the ends. A
    null group key is a group of its own, repeated rows count each time, and a group without any
    defined value has no rows. Columns other than groups and metrics are never read.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    long = df.select(*groups, pairs.alias("__p")).select(*groups, F.col("__p.metric").alias("metric"), F.col("__p.v").alias("__v"))
    long = long.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    return long.groupBy(*groups, "metric", bucket_sign(F.col("__v")).alias("sign"), bucket_index(F.col("__v"), alpha).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Add the counts of equal buckets; ``groups`` may drop keys (days, partitions) of the input."""
    return sketches.groupBy(*groups, "metric", "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: list[str], ps: tuple[float, ...] = PERCENTILES, alpha: float = ALPHA) -> DataFrame:
    """(groups, metric, p, n, value): ``value`` is within ``alpha``, relatively, of the value whose
    0-based rank in ascending order is floor(p * (n - 1))."""
    keys = [*groups, "metric"]
    place = F.col("sign") * F.col("bucket").cast("long")  # zero and the bucket of size 1 differ by sign
    up = Window.partitionBy(*keys).orderBy(F.col("sign"), place)
    counted = sketches.withColumn("__upto", F.sum("n").over(up)).withColumn("__all", F.sum("n").over(Window.partitionBy(*keys)))
    wanted = counted.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    rank = F.floor(F.col("p") * (F.col("__all") - 1))
    hit = wanted.filter((F.col("__upto") > rank) & (F.col("__upto") - F.col("n") <= rank))
    return hit.select(*keys, "p", F.col("__all").alias("n"), bucket_value(F.col("sign"), F.col("bucket"), alpha).alias("value"))
