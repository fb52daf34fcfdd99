"""Filters and pivots over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shorten


def same_cell(wanted: dict[str, object]) -> Column:
    """Null-safe match of cell columns; numbers within 1e-9."""
    out = F.lit(True)
    for name, value in wanted.items():
        if isinstance(value, float):
            out = out & F.coalesce(F.abs(F.col(name) - value) < 1e-9, F.lit(False))
        else:
            out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def pivot_report(df: DataFrame, keys: list[str], by: str, levels: list[str], value: str) -> DataFrame:
    """Mean of ``value`` per key, one column per level of ``by``; the levels are given, so no extra
    pass over the data finds them."""
    columns = [F.round(F.avg(F.when(F.col(by) == level, F.col(value))), 12).alias(level) for level in levels]
    return df.groupBy(*keys).agg(*columns)


def against_baseline(df: DataFrame, keys: list[str], column: str, base: str, value: str) -> DataFrame:
    """Adds delta: ``value`` minus that of the baseline level with equal keys."""
    own = df.filter(F.col(column) == base).groupBy(*keys).agg(F.avg(value).alias("__base"))
    renamed = own.select(*[F.col(k).alias(f"__{k}") for k in keys], "__base")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(renamed, on, "left").withColumn("delta", F.round(F.col(value) - F.col("__base"), 12)).drop("__base", *[f"__{k}" for k in keys])


def close_values(df: DataFrame, column: str, series: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """Rows whose value is that of a given short series, within a tolerance: where a number came
    from. Values are binned, so the match is an equi-join of each bin with itself and its neighbours."""
    near = series.select(F.col("x"), F.explode(F.array(*[F.floor(F.col("x") / tolerance) + d for d in (-1, 0, 1)])).alias("__bin"))
    rows = df.withColumn("__bin", F.floor(F.col(column) / tolerance))
    return rows.join(near, "__bin").filter(F.abs(F.col(column) - F.col("x")) <= tolerance).drop("__bin")


def answer_rows(answers: DataFrame) -> DataFrame:
    """Answers as a flat table for reading: one line each, at most 400 characters."""
    return answers.withColumn("answer", shorten(F.col("answer"), 400)).withColumn("question", shorten(F.col("question"), 300))


def phantom_columns(df: DataFrame, claimed: list[str]) -> dict[str, list[str]]:
    """Claimed columns that are missing, and columns that nobody claimed."""
    have = set(df.columns)
    return {"missing": sorted(set(claimed) - have), "unclaimed": sorted(have - set(claimed))}


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A finished report table as markdown, in its order; null is a dash. A table of more than
    ``most`` rows is no report: a ValueError."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write a file instead")
    line = lambda cells: "| " + " | ".join("-" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def summary(aggregate: DataFrame) -> dict[str, DataFrame]:
    """The standing views of a grid's means: effect of the attack without a defense, defenses
    against each other, and the sweep over epsilon."""
    shown = ["poison_in_topk", "poison_share", "drift_tv", "stance_gap", "n_valid_stance_gap", "mean_score"]
    order = ["attack", "poison_rate", "retriever", "defense", "epsilon"]
    return {
        "attack effect": aggregate.filter(F.col("defense") == "vanilla").select(*order[:3], *shown).orderBy(*order[:3]),
        "defenses": aggregate.filter(F.coalesce("epsilon", F.lit(0.0)) == 0).select(*order[:4], *shown).orderBy(*order[:4]),
        "epsilon": aggregate.filter(F.col("epsilon").isNotNull()).select(*order, *shown).orderBy(*order),
        "adaptive": aggregate.filter(F.col("attack") == "template_plus_projection").select(*order, *shown).orderBy(*order),
    }


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body): the other columns as one JSON object, for figure data."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("body"))


def partial_cells(per_query: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_partial, n_balanced): selections with some but not only injected rows, and those
    of them whose groups are as in the reference."""
    part = (F.col("poison_share") > 0) & (F.col("poison_share") < 1)
    return per_query.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(part, 1).otherwise(0)).alias("n_partial"), F.sum(F.when(part & (F.col("drift_tv") < 1e-9), 1).otherwise(0)).alias("n_balanced"))


def label_audit(rows: DataFrame, label: str, parts: dict[str, str]) -> DataFrame:
    """(label, expected, n, n_held): whether a label holds the text that its kind promises."""
    kind = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    named = rows.withColumn("expected", F.col(label).substr(F.lit(1), F.instr(F.col(label), ":") - 1))
    return named.groupBy("expected").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("client") == kind[F.col("expected")], 1).otherwise(0)).alias("n_held"))


def matched_runs(runs: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(matched, n_runs, n_rows): distinct settings among the runs, with and without a cell of the
    same settings; null settings are equal to each other."""
    own = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    known = cells.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    # equal hashes make it a hash join, where null-safe equality of doubles alone would do, too
    return own.join(known.withColumn("__m", F.lit(1)), on, "left").groupBy((F.col("__m") == 1).alias("m")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("rows").alias("n_rows")).select(F.coalesce("m", F.lit(False)).alias("matched"), "n_runs", "n_rows")


def unchanged(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(n_before, n_after, n_changed, n_new): whether a step left the rows of ``before`` as they were."""
    b = before.select(F.col(key).alias("k"), F.xxhash64(*columns).alias("h"), F.lit(1).alias("b"))
    a = after.select(F.col(key).alias("k2"), F.xxhash64(*columns).alias("h2"), F.lit(1).alias("a"))
    both = b.join(a, F.col("k") == F.col("k2"), "full")
    return both.agg(F.count("b").alias("n_before"), F.count("a").alias("n_after"), F.count(F.when(F.col("b").isNotNull() & ~F.col("h").eqNullSafe(F.col("h2")), 1)).alias("n_changed"), F.count(F.when(F.col("b").isNull(), 1)).alias("n_new"))
