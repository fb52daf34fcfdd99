"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, cutoff, fuzzy, mix, pairs, quantiles, sentences, topn

METRICS = ["drift_tv", "stance_gap"]


def _ten(value):
    """Ten significant digits, alike in every engine."""
    return F.format_string("%.9e", value).cast("double")


def _limits(spark: SparkSession, d: str) -> DataFrame:
    """(source, tokens): what each generator may write at most, null where unknown."""
    return table(spark, d, "generators").select(F.col("generator").alias("source"), F.coalesce("max_tokens", "max_new_tokens").alias("tokens"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "answers"), _limits(spark, d)).select(F.col("id").alias("answer_id"), "defect")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are neither empty nor the question again, and were cut off."""
    return pairs.cut_answers(table(spark, d, "answers"), _limits(spark, d))[0].select(F.col("id").alias("answer_id"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each generator's cut-off answers and their share."""
    return pairs.cut_answers(table(spark, d, "answers"), _limits(spark, d))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of single run days, merged over the days."""
    days = quantiles.sketch(table(spark, d, "by_stratum"), ["run_day", "retriever"], METRICS)
    return quantiles.percentiles(quantiles.merge(days, ["retriever"]), ["retriever"]).withColumn("value", _ten(F.col("value")))


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    days = quantiles.sketch(table(spark, d, "by_stratum"), ["run_day", "retriever"], METRICS)
    return quantiles.percentiles(days, ["run_day", "retriever"], (0.1, 0.5, 0.9)).withColumn("value", _ten(F.col("value")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.similar_pairs(table(spark, d, "docs")).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.groups(table(spark, d, "docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "retrieved"), ["cell_id", "qid"], "doc_id", "score", "ord", 5).select("cell_id", "qid", "doc_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return bpe.decode(bpe.encode(table(spark, d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _quantile_sql(groups: str, ps: tuple[float, ...]) -> str:
    g = quantiles.gamma(quantiles.ALPHA)
    return f"""
with long as (select {groups}, 'drift_tv' as metric, drift_tv as v from by_stratum union all select {groups}, 'stance_gap', stance_gap from by_stratum),
counted as (select {groups}, metric, cast(sign(v) as int) as sg, case when v = 0 then 0 else cast(ceil(ln(abs(v)) / ln({g!r})) as int) end as b, count(*) as c
            from long where v is not null and not isnan(v) group by all),
run as (select *, sum(c) over (partition by {groups}, metric order by sg, sg * b) as upto, sum(c) over (partition by {groups}, metric) as n from counted),
ps as (select unnest({list(ps)!r}) as p)
select {groups}, metric, cast(p as double) as p, cast(n as bigint) as n,
       cast(format('{{:.9e}}', case when sg = 0 then 0.0 else sg * exp(b * ln({g!r}) + ln({2 / (1 + g)!r})) end) as double) as value
from run, ps where upto > floor(p * (n - 1)) and upto - c <= floor(p * (n - 1))"""


QUERIES = {
    "p1_found": p1_found,
    "p2_percentiles": p2_percentiles,
    "p2_daily": p2_daily,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_shares": p5_shares,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}

ORACLE_SQL = {
    "p2_percentiles": _quantile_sql("retriever", quantiles.PERCENTILES),
    "p2_daily": _quantile_sql("run_day, retriever", (0.1, 0.5, 0.9)),
    "p4_found": """
select cell_id, qid, doc_id from (
  select cell_id, qid, doc_id, row_number() over (partition by cell_id, qid order by s desc, o, doc_id) as place from (
    select cell_id, qid, doc_id, max(score + 0.0) as s, min(ord) as o from retrieved
    where score is not null and not isnan(score) and doc_id is not null group by cell_id, qid, doc_id))
where place <= 5""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
