"""Set statistics over a stream of retrieval results.

Rows (cell_id, qid, doc_id, grp, stance, is_poison, score, loaded_at) arrive in any order, some
again and some late. Rows sent again within the watermark are dropped by key; windows close once
the watermark passes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(stream: DataFrame, keys: list[str], at: str = "loaded_at", late: str = "3 days") -> DataFrame:
    """Each key once within the watermark; state older than it is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_shares(stream: DataFrame, at: str = "loaded_at", size: str = "1 day", late: str = "3 days") -> DataFrame:
    """(start, cell_id, n, n_scored, poison_share, favourable, n_relevant) per window and cell; null
    and NaN scores are not counted as scored."""
    relevant = F.col("grp").isNotNull() & (F.col("stance") != 0)
    rows = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "cell_id")
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("score").isNotNull() & ~F.isnan("score"), 1).otherwise(0)).alias("n_scored"),
        F.avg(F.when(F.col("is_poison"), 1.0).otherwise(0.0)).alias("poison_share"),
        F.avg(F.when(relevant, F.when(F.col("stance") > 0, 1.0).otherwise(0.0))).alias("favourable"), F.sum(F.when(relevant, 1).otherwise(0)).alias("n_relevant"),
    )
    return out.select(F.col("w.start").alias("start"), "cell_id", "n", "n_scored", "poison_share", "favourable", "n_relevant")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there, then stop; the result is the in-memory table ``name``."""
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
