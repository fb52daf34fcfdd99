"""Mixing sources to target shares by weighted fair queueing.

Every source is a queue of shuffled documents. A document's virtual finish time is the number of
tokens its source has sent up to and with it, divided by the source's target share. At virtual time
V every source has sent its share of V tokens, so the mix is the documents whose middle is sent by
the budget, range-sorted by finish time: a share is met within half a document. The budget, unless given, is the largest at which no source runs
out of its permitted repetitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import bpe

#: Slices of a source whose token sums are added up first; no task ever sees a whole source.
SLICES = 4096


def plan(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """(mix_id, source, target_share, share, max_repeats, source_docs, source_tokens, budget):
    one row per target. ``share`` is the target share among the sources that have tokens."""
    own = Window.partitionBy("mix_id")
    rows = targets.select("mix_id", "source", F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("long").alias("max_repeats"))
    rows = rows.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.join(sizes.select(F.col("source").alias("__s"), "source_docs", "source_tokens"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    rows = rows.fillna(0, ["source_docs", "source_tokens"])
    live = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    rows = rows.withColumn("share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(own)))
    most = F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("share")).over(own)
    return rows.withColumn("budget", most if budget is None else F.least(most, F.lit(float(budget))))


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7, doc: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) for every mix of ``targets`` (mix_id, source, target_share, max_repeats).

    ``chosen``: (mix_id, source, doc_id, copy, n_tokens, finish), ordered by mix and finish time;
    ``copy`` counts from 1. ``shares``: (mix_id, source, target_share, docs, rows, tokens, budget,
    actual_share), one row per target, also of sources that send nothing.

    Sizes are tokens of byte_bpe_50k. Sources without documents or tokens can't reach their target:
    their actual share is 0 and the other targets are scaled up. A source without a target is not
    used. Documents with null, empty or no-token texts have size 0 and are left out; a null source
    only matches a null target. max_repeats null means 1. A document id that occurs in several rows
    is several documents. Documents with equal shuffle keys are ordered by id.
    """
    aimed = targets.select(F.col("source").alias("__a")).distinct()
    docs = docs.join(aimed, docs[source].eqNullSafe(F.col("__a")), "left_semi")  # others are never tokenized
    sized = bpe.count(docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), ["doc_id", "source"], "text")
    sized = cut(sized.filter(F.col("n_tokens") > 0).withColumn("twin", F.monotonically_increasing_id()))
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("n_tokens").alias("source_tokens"))
    goal = cut(plan(sizes, targets, budget))

    # Passes each source needs: at most its max_repeats; one row per source, pass and mix.
    passes = goal.filter(F.col("share").isNotNull()).withColumn("passes", F.least(F.col("max_repeats"), F.ceil(F.col("budget") * F.col("share") / F.col("source_tokens") - 1e-9)))
    passes = passes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("passes"), F.lit(1))))).select("mix_id", F.col("source").alias("__s"), "share", "budget", "source_tokens", "copy")
    turns = passes.groupBy(F.col("__s").alias("__t")).agg(F.max("copy").alias("most"))

    # Every pass shuffles anew; a slice is a range of the shuffle key.
    queued = sized.join(turns, F.col("source").eqNullSafe(F.col("__t"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    queued = queued.withColumn("place", F.xxhash64(F.col("doc_id"), F.col("copy"), F.lit(seed))).select("source", "doc_id", "twin", "n_tokens", "copy", "place", F.pmod(F.shiftright("place", 52), F.lit(SLICES)).cast("int").alias("slice"))
    lane = ["source", "copy"]
    slices = queued.groupBy(*lane, "slice").agg(F.sum("n_tokens").alias("in_slice"))
    before = Window.partitionBy(*lane).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("source").alias("__s1"), F.col("copy").alias("__c1"), F.col("slice").alias("__i1"), F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*lane, "slice").orderBy("place", "doc_id", "twin").rowsBetween(Window.unboundedPreceding, 0)
    upto = queued.withColumn("upto", F.sum("n_tokens").over(inside))
    upto = upto.join(starts, F.col("source").eqNullSafe(F.col("__s1")) & (F.col("copy") == F.col("__c1")) & (F.col("slice") == F.col("__i1"))).select("source", "copy", "doc_id", "n_tokens", (F.col("upto") + F.col("start")).alias("upto"))
    sent = upto.join(passes.withColumnRenamed("copy", "__c2"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("copy") == F.col("__c2")))
    sent = sent.withColumn("finish", (F.col("upto") + (F.col("copy") - 1) * F.col("source_tokens")) / F.col("share"))
    middle = F.col("finish") - F.col("n_tokens") / F.col("share") / 2
    chosen = cut(sent.filter(middle <= F.col("budget") * (1 + 1e-12)).select("mix_id", "source", "doc_id", "copy", "n_tokens", "finish"))

    got = chosen.groupBy(F.col("mix_id").alias("__m"), F.col("source").alias("__s3")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("copy") == 1, 1).otherwise(0)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    shares = goal.join(got, F.col("mix_id").eqNullSafe(F.col("__m")) & F.col("source").eqNullSafe(F.col("__s3")), "left").fillna(0, ["rows", "docs", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    shares = shares.select("mix_id", "source", "target_share", "docs", "rows", "tokens", "budget", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"))
    return chosen.orderBy("mix_id", "finish", "source", "doc_id", "copy"), shares
