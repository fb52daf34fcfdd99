import math
import random

import numpy as np

from tallyloom.llm import fuzzy

WORDS = [f"{a}{b}" for a in "ka lo mi ne pu ra si to vu za".split() for b in "bel dor fin gar hul jan".split()]


def corpus(seed=1, n=300, size=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(size)]
        rows.append(" ".join(base))
        if i % 3 == 0:
            edited = list(base)
            for _ in range(r.randrange(1, 7)):
                edited[r.randrange(size)] = "new" + str(r.randrange(99))
            if i % 2:
                edited = edited[20:] + edited[:20]
            rows.append(", ".join(edited).upper())
    return rows


def brute(rows, limit=0.5):
    out = set()
    for i, a in enumerate(rows):
        for j in range(i):
            if a and rows[j] and fuzzy.similarity(a, rows[j]) >= limit:
                out.add((j, i))
    return out


def test_code_is_perfect():
    code = fuzzy.Golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000, dtype=np.int64).astype(np.int32)
    near = code.decode(words)
    assert (code.decode(near) == near).all()
    assert max(bin(int(x)).count("1") for x in near ^ words) == 3
    for flips in range(3):
        noisy = near.copy()
        for b in np.random.default_rng(flips).choice(23, flips, replace=False):
            noisy ^= np.int32(1 << b)
        assert (code.decode(noisy) == near).all()


def test_nearest_is_ordered_and_costs_are_right():
    m = np.random.default_rng(2).standard_normal((50, 23)).astype(np.float32)
    code = fuzzy.Golay()
    index, cost = fuzzy.nearest(code, m, 4)
    assert (cost[:, 1:] >= cost[:, :-1]).all()
    every = np.array([c for c in range(1 << 12)])
    words = np.array([(e << 11) | fuzzy._remainder(e << 11) for e in every])
    signs = (words[:, None] >> np.arange(23) & 1) * 2 - 1
    true = (np.abs(m)[:, None, :] * (signs[None] != np.where(m > 0, 1, -1)[:, None, :])).sum(2)
    got = np.take_along_axis(true, index[:, :1], 1)[:, 0]
    assert np.allclose(got, cost[:, 0], atol=1e-4)
    assert (cost[:, 0] <= np.sort(true, axis=1)[:, 0] + 1e-4).mean() >= 0.85


def test_recall_and_precision_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "c", "a") for i, t in enumerate(rows)], "ord long, text string, copy string, a string").repartition(5)
    got = {(r.a, r.b) for r in fuzzy.similar_pairs(df).collect()}
    true = brute(rows)
    assert got <= true
    assert len(got & true) >= 0.95 * len(true) > 0


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "single"), (5, "single"), (6, "two words"), (7, "Two WORDS"), (8, "two words"), (None, "two words"), (9, long), (10, long + " end"), (11, "!!! ---"), (12, "two, words!")]
    df = spark.createDataFrame(rows, "ord long, text string")
    got = {(r.a, r.b): r.similarity for r in fuzzy.similar_pairs(df).collect()}
    assert {(6, 7), (6, 8), (7, 8), (9, 10), (6, 12), (7, 12), (8, 12)} == set(got)
    assert got[6, 7] == 1.0 and got[6, 12] == 1.0
    assert fuzzy.similar_pairs(df.limit(0)).count() == 0


def test_groups_are_components(spark):
    rows = corpus(5, 60)
    rows += [rows[0], rows[0], "lonely text of its own here"]
    df = spark.createDataFrame(list(enumerate(rows)), "ord long, text string")
    got = {r.ord: (r.group, r.links) for r in fuzzy.groups(df).collect()}
    pairs = {(r.a, r.b) for r in fuzzy.similar_pairs(df).collect()}
    label = list(range(len(rows)))
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert set(got) == {x for p in pairs for x in p}
    assert all(got[x][0] == label[x] for x in got)
    assert fuzzy.groups(df.limit(0)).count() == 0


def test_a_third_of_copies_makes_no_candidates(spark):
    rows = corpus(7, 40) + ["this very text is copied again and again"] * 30
    df = spark.createDataFrame(list(enumerate(rows)), "ord long, text string").coalesce(1)
    docs = fuzzy.prepared(df, "ord", "text")
    first = len(rows) - 30
    assert all(r.a < first and r.b < first for r in fuzzy.candidates(docs).collect() if r.a >= first or r.b >= first)
    assert fuzzy.copies(docs).count() >= 29


def test_sketch_loses_no_pairs_at_the_limit(spark):
    both = 0.5
    short, long = ([math.comb(n, k) * (p := both + (1 - both) / size) ** k * (1 - p) ** (n - k) for k in range(n + 1)] for n, size in ((fuzzy.SHORT, 4), (fuzzy.LONG, 2)))
    assert sum(short[: fuzzy.SHORT_ALIKE]) < 0.001
    weigh = lambda a, b: fuzzy.WEIGHTS[0] * a + fuzzy.WEIGHTS[1] * b
    assert sum(x * y for a, x in enumerate(short) for b, y in enumerate(long) if weigh(a, b) < fuzzy.ALIKE) < 0.001
    r = random.Random(3)
    rows = []
    for _ in range(400):
        base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(60)]
        rows += [" ".join(base), " ".join(base[:41] + [f"x{r.randrange(9999)}" for _ in range(19)])]
    which, packed, *_ = fuzzy.Fingerprints().rows(rows)
    keys = [set() for _ in rows]
    for i, k in zip(which.tolist(), packed.tolist()):
        keys[i].add(k >> 36)
    met = {(i, i + 1) for i in range(0, len(rows), 2) if keys[i] & keys[i + 1] and fuzzy.similarity(rows[i], rows[i + 1]) >= 0.5}
    docs = fuzzy.prepared(spark.createDataFrame(list(enumerate(rows)), "ord long, text string"), "ord", "text")
    assert len(met) > 50
    assert len(met - {(x.a, x.b) for x in fuzzy.candidates(docs).collect()}) <= 0.01 * len(met)
