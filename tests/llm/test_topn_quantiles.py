import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quantiles, topn

SCHEMA = "k string, q string, d string, s double, o long, position int, floor_bin int"


def brute(rows, n):
    best = {}
    for k, q, d, s, o, *_ in rows:
        if d is None or s is None or math.isnan(s):
            continue
        own = best.setdefault((k, q), {})
        old = own.get(d, (-math.inf, None))
        ties = [x for x in (old[1], o) if x is not None]
        own[d] = (max(old[0], s), min(ties) if ties else None)
    out = set()
    for key, own in best.items():
        order = sorted(own, key=lambda d: (-own[d][0], own[d][1] is None, own[d][1] or 0, d))
        out |= {(*key, d) for d in order[:n]}
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(6000):
        k = r.choice(["a", "b", None]) if r.random() < 0.3 else "hot"
        d = f"d{r.randrange(400)}" if r.random() > 0.01 else None
        s = r.choice([None, float("nan"), 0.0, -0.0, float("inf"), r.gauss(0, 1), float(round(r.gauss(0, 3))), -float("inf")])
        rows.append((k, r.choice(["x", "y"]), d, s, None if d is None or d == "d7" else int(d[1:]) // 2, i, i))
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 5, 40):
        got = {(x.k, x.q, x.d) for x in topn.top_n(df, ["k", "q"], "d", "s", "o", n).collect()}
        assert got == brute(rows, n)
    assert topn.top_n(df, ["k", "q"], "d", "s", "o", 0).count() == 0
    assert topn.top_n(df.limit(0), ["k", "q"], "d", "s", "o", 5).count() == 0


def test_thresholds_are_used_and_safe_with_repeats(spark):
    # one document sent again with every score can't stand for five
    rows = [("g", "q", "same", float(i), 1, 0, 0) for i in range(200)] + [("g", "q", f"e{i}", -float(i), i, 0, 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("k"), F.col("d"), topn.score_bin(F.col("s")).alias("b"))
    floor = topn.thresholds(df, ["k"], "d", "b", 5).first()
    assert floor.floor_bin <= 0
    got = {x.d for x in topn.top_n(spark.createDataFrame(rows, SCHEMA), ["k", "q"], "d", "s", "o", 5).collect()}
    assert got == {"same", "e0", "e1", "e2", "e3"}


def test_bins_never_fall(spark):
    values = sorted([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), -float("inf"), *np.random.default_rng(1).standard_normal(300).tolist(), 1.0, 2.0, 0.999999999999])
    bins = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(topn.score_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)


def test_error_bound_and_merging(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in ("a", None):
        for day in range(5):
            for v in np.concatenate([10 ** rng.uniform(-12, 6, 300), -(10 ** rng.uniform(-3, 3, 100)), np.zeros(60), [float("nan")] * 5]):
                rows.append((g, day, float(v), float(v) if rng.random() > 0.5 else None))
    df = spark.createDataFrame(rows, "g string, day int, x double, y double")
    days = quantiles.sketch(df, ["g", "day"], ["x", "y"])
    got = quantiles.percentiles(quantiles.merge(days, ["g"]), ["g"]).collect()
    whole = quantiles.percentiles(quantiles.sketch(df, ["g"], ["x", "y"]), ["g"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole))
    assert len(got) == 2 * 2 * len(quantiles.PERCENTILES)
    for r in got:
        own = sorted(x for g, _, *xy in rows if g == r.g and (x := xy[r.metric == "y"]) is not None and not math.isnan(x))
        exact = own[math.floor(r.p * (len(own) - 1))]
        assert r.n == len(own)
        assert abs(r.value - exact) <= quantiles.ALPHA * abs(exact) * (1 + 1e-9)


def test_quantile_edges(spark):
    df = spark.createDataFrame([("a", float("inf"), 1), ("a", -float("inf"), 2), ("a", 0.0, 3), ("b", None, 4), ("c", float("nan"), 5)], "g string, x double, metric int")
    got = {(r.g, r.p): r.value for r in quantiles.percentiles(quantiles.sketch(df, ["g"], ["x"]), ["g"], (0.0, 0.5, 1.0)).collect()}
    assert got == {("a", 0.0): -math.inf, ("a", 0.5): 0.0, ("a", 1.0): math.inf}
    assert quantiles.percentiles(quantiles.sketch(df.limit(0), ["g"], ["x"]), ["g"]).count() == 0
    one = spark.createDataFrame([("a", 3.0)], "g string, x double")
    assert quantiles.percentiles(quantiles.sketch(one, ["g"], ["x"]), ["g"], (0.5,)).first().value == pytest.approx(3.0, rel=quantiles.ALPHA)


def test_last_bucket_is_finite(spark):
    import sys

    big = sys.float_info.max
    df = spark.createDataFrame([("g", big), ("g", -big), ("g", 5e-324)], "k string, v double")
    got = {r.p: r.value for r in quantiles.percentiles(quantiles.sketch(df, ["k"], ["v"]), ["k"], (0.0, 1.0)).collect()}
    assert abs(got[1.0] / big - 1) <= 0.0051 and abs(got[0.0] / big + 1) <= 0.0051


def test_percentiles_against_exact_ones(spark):
    """Within the promised relative error of the exact value of the same rank, whatever the spread."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 6, 4000), -rng.lognormal(-3, 4, 2000), np.zeros(50)])
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, v double")
    exact = np.sort(values)
    for r in quantiles.percentiles(quantiles.sketch(df, ["k"], ["v"]), ["k"]).collect():
        want = exact[int(np.floor(r.p * (len(values) - 1)))]
        assert abs(r.value - want) <= quantiles.ALPHA * abs(want) * 1.0001
