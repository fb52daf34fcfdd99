"""Constrained re-ranking of fetched candidates.

Candidates are (keys, ord, grp, stance, score, ...) with at most ``fetch_size(k)`` rows per key,
limited by a window ahead of everything here. Group mode is pure windows; the stance modes are a
sequential rule over those few rows and run as one grouped function for the whole grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import counter_random, mixed
from ..session import ship
from .retrieve import top_k


def vanilla(candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    return top_k(candidates, keys, k)


def above(candidates: DataFrame, floor: float = float("-inf")) -> DataFrame:
    """Candidates whose score reaches the relevance floor; the default keeps all."""
    return candidates if floor == float("-inf") else candidates.filter(F.col("score") >= floor)


def group_budget(candidates: DataFrame, keys: list[str], k: int, epsilon: Column | float, shares: dict[str, float] | None = None) -> DataFrame:
    """Group mode: of each group, at most its share of k plus epsilon k are admitted, neutral rows
    always; the rest of k is filled by score. Shares are uniform over the groups among the
    candidates, or those of ``shares`` (0 for a group that isn't there). Adds ``admitted`` and the final ``rnk``.

    Exact as windows, because the n-th admitted row of a group is its n-th best.
    """
    eps = F.lit(float(epsilon)) if isinstance(epsilon, int | float) else epsilon
    own = Window.partitionBy(*keys)
    by_score = [F.col("score").desc(), F.col("ord").asc()]
    relevant = F.col("grp").isNotNull() & (F.col("stance") != 0)
    rows = candidates.withColumn("__groups", F.size(F.collect_set(F.when(relevant, F.col("grp"))).over(own)))
    known = F.max(F.when(relevant, 1).otherwise(0)).over(Window.partitionBy(*keys, "grp")) == 1
    rows = rows.withColumn("__known", F.col("grp").isNotNull() & known).withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "grp").orderBy(*by_score)))
    share = 1 / F.greatest(F.col("__groups"), F.lit(1))
    if shares is not None:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("grp")], F.lit(0.0))
    allowed = k * share + eps * k
    rows = rows.withColumn("admitted", ~F.col("__known") | (F.col("__place") - 1 < allowed))
    chosen = rows.withColumn("__pick", F.row_number().over(own.orderBy(F.col("admitted").desc(), *by_score))).filter(F.col("__pick") <= k)
    final = own.orderBy(F.col("score").desc(), F.col("admitted").desc(), F.col("ord").asc())
    return chosen.withColumn("rnk", F.row_number().over(final)).drop("__groups", "__known", "__place", "__pick")


def constrained(ords: Sequence[int], groups: Sequence[str | None], stances: Sequence[int], scores: Sequence[float], k: int, epsilon: float, mode: str = "both", fixed: bool = False) -> tuple[list[int], dict[str, float]]:
    """Positions chosen from candidates in the given order, by score, and a trace.

    A favourable row of a group is admitted while the group's favourable rows stay within its rate
    (0.5) plus epsilon of its admitted rows, so the first row of a group can't be a favourable one;
    ``fixed`` counts the row itself and lifts the group cap in stance mode. Afterwards, a group
    short of favourable rows gets its best ones in exchange for its weakest unfavourable ones.
    """
    n = len(ords)
    order = sorted(range(n), key=lambda i: (-scores[i], ords[i]))
    names = sorted({g for g, s in zip(groups, stances, strict=True) if g is not None and s != 0})
    trace = {"skipped": 0.0, "repaired": 0.0, "exhausted": 0.0, "fallback": 0.0, "drift_group": math.nan, "drift_stance": math.nan}
    if not names:
        return order[:k], trace
    stance_rules, rate = mode in ("stance", "both"), 0.5
    cap = {g: math.inf if fixed and mode == "stance" else k / len(names) + (epsilon * k if mode in ("group", "both") else 0.0) for g in names}
    used, favoured = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    chosen: list[int] = []
    for i in order:
        if len(chosen) == k:
            break
        g = groups[i]
        if g in used:
            above = stance_rules and stances[i] > 0 and favoured[g] + 1 > (used[g] + fixed) * (rate + epsilon)
            if used[g] >= cap[g] or above:
                trace["skipped"] += 1
                continue
            used[g] += 1
            favoured[g] += stances[i] > 0
        chosen.append(i)
    if len(chosen) < k:
        trace["exhausted"] = 1.0
        spare = [i for i in order if i not in set(chosen)][: k - len(chosen)]
        trace["fallback"] = float(bool(spare))
        chosen += spare
    if stance_rules:
        for g in names:
            mine = [i for i in chosen if groups[i] == g and stances[i] != 0]
            have = sum(stances[i] > 0 for i in mine)
            need = math.ceil(len(mine) * max(rate - epsilon, 0.0) - 1e-9)
            better = [i for i in order if i not in set(chosen) and groups[i] == g and stances[i] > 0]
            while have < need and better:
                worst = min((i for i in chosen if groups[i] == g and stances[i] < 0), key=lambda i: (scores[i], i), default=None)
                if worst is None:
                    break
                chosen.remove(worst)
                chosen.append(better.pop(0))
                have += 1
                trace["repaired"] += 1
    chosen.sort(key=lambda i: -scores[i])
    counts = {g: [stances[i] > 0 for i in chosen if groups[i] == g and stances[i] != 0] for g in names}
    total = sum(map(len, counts.values()))
    trace["drift_group"] = sum(abs((len(c) / total if total else 0.0) - 1 / len(names)) for c in counts.values()) / 2
    shifts = [abs(sum(c) / len(c) - rate) for c in counts.values() if c]
    trace["drift_stance"] = max(shifts) if shifts else math.nan
    return chosen, trace


TRACE = ("skipped", "repaired", "exhausted", "fallback", "drift_group", "drift_stance")


def stance_budget(candidates: DataFrame, keys: list[str], k: int, epsilon: Column | float, mode: str = "both", fixed: bool = False) -> DataFrame:
    """(keys, rnk, ord, score, and the trace columns): the stance modes over each key's few rows."""
    ship(candidates.sparkSession)
    own = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "ord", "grp", F.col("stance").cast("int").alias("stance"))))
    eps = F.lit(float(epsilon)) if isinstance(epsilon, int | float) else epsilon
    rows = candidates.groupBy(*keys).agg(own.alias("rows"), F.max(eps).alias("eps"))  # at most fetch_size(k) rows a key
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, columns = [], [[] for _ in range(3 + len(TRACE))]
            for at, (own, eps) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                scores = [-r["down"] for r in own]
                picked, trace = constrained([r["ord"] for r in own], [r["grp"] for r in own], [r["stance"] or 0 for r in own], scores, k, eps, mode, fixed)
                for place, i in enumerate(picked, 1):
                    of.append(at)
                    for column, value in zip(columns, (place, own[i]["ord"], scores[i], *(trace[t] for t in TRACE)), strict=True):
                        column.append(value)
            take = pa.array(of, pa.int64())
            arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[2:]]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keys))], *arrays], names=[*keys, "rnk", "ord", "score", *TRACE])

    return rows.mapInArrow(run, f"{kinds}, rnk int, ord long, score double, " + ", ".join(f"{t} double" for t in TRACE))


def variants(queries: DataFrame, n: int = 5, rate: float = 0.05) -> DataFrame:
    """(qid, v, text): each query as it is (v = 0) and n times with each word dropped at ``rate`` by
    counter hash of (qid, v, position); where none is, one word drawn by (qid, v) is. A query with
    no word left stays as it is."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = queries.select("qid", "text", words.alias("ws"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("v"))
    below = F.transform(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.pmod(mixed(counter_random(F.col("qid"), F.col("v"), i)), F.lit(10_000)) >= round(rate * 10_000))
    rows = rows.withColumn("keep", below)
    one = F.pmod(mixed(counter_random(F.col("qid"), F.col("v"))), F.size("ws"))
    left = F.array_join(F.filter("ws", lambda w, i: F.when(F.forall("keep", lambda x: x), i != one).otherwise(F.get("keep", i))), " ")
    return rows.select("qid", "v", F.when((F.col("v") == 0) | (left == ""), F.col("text")).otherwise(left).alias("text"))


def consistency(ranked: DataFrame, n: int, k: int, w_freq: float = 1.0, w_rank: float = 1.0) -> DataFrame:
    """(qid, ord, score, rnk) from the rankings (qid, v, ord, rnk) of n variants: how often a
    document appears plus the inverse of its mean rank; ties by first sight (variant, then rank)."""
    seen = ranked.groupBy("qid", "ord").agg(F.count(F.lit(1)).alias("c"), F.avg("rnk").alias("r"), F.min(F.struct("v", "rnk")).alias("first"))
    scored = seen.withColumn("score", F.round(w_freq * F.col("c") / n + w_rank / F.col("r"), 9))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("first"))
    return scored.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k).select("qid", "ord", "score", "rnk")


def moment_matrix(vectors: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, centred moments) of the vectors (v). Sums and the d x d matrix are added up by
    partition, so the driver gets one matrix for d up to about a thousand."""
    ship(vectors.sparkSession)

    def moments(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                part = np.concatenate([[[float(len(x))] + [0.0] * (x.shape[1] - 1)], x.sum(0)[None], x.T @ x])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel()], "d": [total.shape[1]]})

    rows = vectors.select(F.col("v").cast("array<double>").alias("v")).filter(F.col("v").isNotNull()).mapInPandas(moments, "m array<double>, d int")
    added = rows.select("d", F.posexplode("m").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), F.max("d").alias("d"))
    flat = added.orderBy("p").toPandas()
    if not len(flat):
        return 0.0, np.zeros(0), np.zeros((0, 0))
    d = int(flat["d"].iloc[0])
    m = flat["x"].to_numpy().reshape(-1, d)
    n, mean = m[0, 0], m[1] / m[0, 0]
    return float(n), mean, m[2:] - n * np.outer(mean, mean)


def manifold(vectors: DataFrame, rank: int = 16) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(mean, basis, residual mean, residual deviation) of the vectors (v): the eigenvectors of the
    moment matrix span what the singular ones do."""
    n, mean, moments = moment_matrix(vectors)
    values, vectors_ = np.linalg.eigh(moments)
    basis = vectors_[:, ::-1][:, : min(rank, len(mean))].T
    sizes = vectors.select(residual(F.col("v"), mean, basis).alias("r")).agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sd")).first()
    return mean, basis, float(sizes["mu"]), float(sizes["sd"]) + 1e-9


def residual(v: Column, mean: np.ndarray, basis: np.ndarray) -> Column:
    """Distance of a vector from the manifold."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        c = np.stack(x.to_numpy()).astype(float) - mean
        return pd.Series(np.linalg.norm(c - (c @ basis.T) @ basis, axis=1))

    return run(v.cast("array<double>"))


def penalised(candidates: DataFrame, keys: list[str], k: int, model: tuple[np.ndarray, np.ndarray, float, float], beta: float = 1.0) -> DataFrame:
    """Top k by score minus beta times the off-manifold penalty of ``v``, which is never negative."""
    mean, basis, mu, sd = model
    away = F.greatest((residual(F.col("v"), mean, basis) - mu) / sd, F.lit(0.0))
    return top_k(candidates.withColumn("score", F.round(F.col("score") - beta * away, 9)), keys, k)


RULES: dict[str, Callable[..., DataFrame]] = {"vanilla": vanilla, "repr_group": group_budget, "repr_stance": stance_budget, "repr_both": stance_budget}
