"""The experiment grid as one plan: conditions x retrievers x rules, one ``cell_id`` each.

Only the grid is a loop on the driver. The candidates of all cells are one relation, limited per
(cell, query) ahead of re-ranking; one evaluation and one aggregation cover the whole grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attack, metrics, retrieve, select
from ..session import cut
from ..sources import corpus

DEFAULTS = {
    "attacks": ["clean", "template", "template_plus_projection"], "rates": [0.001, 0.0025, 0.005, 0.01, 0.02], "retrievers": ["bm25", "dense"], "modes": ["group", "stance", "both"],
    "epsilons": [0.0, 0.1, 0.25, 0.5, 1.0], "others": ["multi_query", "manifold"], "variants": 5, "lam": 1.0, "k": 5, "seed": 0,
}
KEYS = ["cell_id", "qid"]
#: Retrievers that rank by vectors: only these can be pushed along the queries or held to a manifold.
VECTORS = ("dense",)


def grid(config: dict) -> list[dict]:
    """The cells: the clean condition once, each attack at each rate; per retriever the undefended
    ranking, the consistency of variants, the manifold (vectors only), and every mode at every
    epsilon. A push changes nothing for lexical retrievers: their cells are those of the template."""
    conditions = [(a, r) for a in config["attacks"] for r in ([None] if a == "clean" else config["rates"])]
    modes = [(f"repr_{m}", float(e)) for m in config["modes"] for e in config["epsilons"]]
    cells = []
    for a, r in conditions:
        for t in config["retrievers"]:
            others = [(o, None) for o in config["others"] if o != "manifold" or t in VECTORS]
            cells += [{"attack": a, "poison_rate": r, "retriever": t, "defense": d, "epsilon": e} for d, e in [("vanilla", None), *others, *modes]]
    return [{"cell_id": i, **c} for i, c in enumerate(cells)]


def cells_frame(spark: SparkSession, cells: Sequence[dict]) -> DataFrame:
    names = ["cell_id", "attack", "poison_rate", "retriever", "defense", "epsilon"]
    return spark.createDataFrame([tuple(c[n] for n in names) for c in cells], "cell_id int, attack string, poison_rate double, retriever string, defense string, epsilon double")


def dense_vectors(rows: DataFrame, key: str) -> DataFrame:
    return retrieve.to_dense(rows, retrieve.hash_embed(rows, key), key)


def rankings(docs: DataFrame, queries: DataFrame, retriever: str, fetch: int, lam: float | None) -> DataFrame:
    """(qid, ord, score, rnk): what a retriever fetches; with ``lam``, injected vectors are pushed
    along the mean of the first variants."""
    if lam is None:
        return retrieve.top_by_text(docs, queries, fetch, retriever, zeros=True)
    asked = dense_vectors(queries, "qid")
    moved = attack.projected(dense_vectors(docs, "ord").join(docs.select("ord", "is_poison"), "ord"), asked.filter(F.col("qid").endswith("#0")), lam)
    return retrieve.vector_top_k(moved.select("ord", "v"), asked, fetch)


def run(spark: SparkSession, world: dict[str, DataFrame], config: dict | None = None) -> dict[str, DataFrame]:
    """cells, per_query, aggregate and by_stratum (keys include the rate) of the grid over a world of
    docs, queries, pool and strata; docs are the clean corpus. ``world["poison"]`` may give the
    injected rows of a rate; without it they are made from the corpus."""
    config = {**DEFAULTS, **(config or {})}
    cells = grid(config)
    docs, k = world["docs"], config["k"]
    n_docs, fetch = docs.count(), retrieve.fetch_size(config["k"])
    # a query and its variants are ranked together; variant 0 is the query itself
    n = config["variants"] if "multi_query" in config["others"] else 0
    asked = cut(select.variants(world["queries"], n).select(F.concat_ws("#", "qid", "v").alias("qid"), "text"))
    qid, variant = F.substring_index("qid", "#", 1), F.substring_index("qid", "#", -1).cast("int")
    corpora, fetched = {}, {}
    for c in cells:
        pushed = c["attack"] == "template_plus_projection" and c["retriever"] in VECTORS
        rate, at = c["poison_rate"], (c["poison_rate"], c["retriever"], pushed)
        if rate not in corpora:
            if rate is None:
                corpora[rate] = docs
            elif "poison" in world:
                corpora[rate] = docs.unionByName(world["poison"](rate))
            else:
                corpora[rate] = attack.appended(docs, attack.injected(docs, world["strata"], max(1, round(rate * n_docs)), config["seed"]))
        fetched.setdefault(at, None)
    # the plans look up the sizes of what they broadcast: small jobs, several at a time
    with ThreadPoolExecutor(8) as pool:
        made = pool.map(lambda at: rankings(corpora[at[0]], asked, at[1], fetch, config["lam"] if at[2] else None), fetched)
        fetched = dict(zip(fetched, made, strict=True))
    names = {at: i for i, at in enumerate(fetched)}
    # one written table holds what every condition and retriever fetched
    rows = cut(reduce(DataFrame.unionByName, [df.select(F.lit(names[at]).alias("f"), qid.alias("qid"), variant.alias("v"), F.col("ord").cast("long").alias("ord"), F.col("score").cast("double").alias("score"), F.col("rnk").cast("int").alias("rnk")) for at, df in fetched.items()]))
    wide = sorted(corpora, key=lambda r: r or 0.0)
    texts = reduce(DataFrame.unionByName, [corpora[r].filter("is_poison").drop("text").withColumn("rate", F.lit(r)) for r in wide if r is not None], docs.drop("text").withColumn("rate", F.lit(None).cast("double")))
    of = spark.createDataFrame([(names[at], at[0]) for at in fetched], "f int, rate double")
    own = rows.join(F.broadcast(of), "f").withColumnRenamed("ord", "o").withColumnRenamed("rate", "at")
    # passages by corpus: clean ones belong to every rate
    described = cut(own.join(texts, (F.col("o") == F.col("ord")) & (F.col("rate").isNull() | (F.col("rate") == F.col("at")))).drop("o", "at", "rate"))
    frame = cells_frame(spark, cells)
    keyed = spark.createDataFrame([(c["cell_id"], names[c["poison_rate"], c["retriever"], c["attack"] == "template_plus_projection" and c["retriever"] in VECTORS], c["defense"]) for c in cells], "cell_id int, f int, rule string")
    eps = spark.createDataFrame([(c["cell_id"], c["epsilon"] or 0.0) for c in cells], "cell_id int, eps double")
    plain = described.filter("v = 0").drop("v", "rnk").join(F.broadcast(keyed), "f").join(F.broadcast(eps), "cell_id")
    parts = [select.vanilla(plain.filter("rule = 'vanilla'"), KEYS, k), select.group_budget(plain.filter("rule = 'repr_group'"), KEYS, k, F.col("eps"))]
    for mode in ("stance", "both"):
        mine = plain.filter(F.col("rule") == f"repr_{mode}")
        if mode in config["modes"]:
            parts.append(mine.join(select.stance_budget(mine, KEYS, k, F.col("eps"), mode).select(*KEYS, "ord"), [*KEYS, "ord"]))
    if "multi_query" in config["others"]:
        every = described.join(F.broadcast(keyed.filter("rule = 'multi_query'")), "f")
        key = F.concat_ws("#", "cell_id", "qid")
        best = select.consistency(every.select(key.alias("qid"), "v", "ord", "rnk"), n + 1, k)
        best = best.select(F.substring_index("qid", "#", 1).cast("int").alias("cell_id"), F.substring_index("qid", "#", -1).alias("qid"), "ord", "score")
        about = every.select("cell_id", "qid", "ord", "doc_id", "grp", "stance", "is_poison").distinct()
        parts.append(best.join(about, [*KEYS, "ord"]))
    if "manifold" in config["others"] and any(c["defense"] == "manifold" for c in cells):
        clean = cut(dense_vectors(docs, "ord"))
        mine = plain.filter("rule = 'manifold'")
        poison = reduce(DataFrame.unionByName, [corpora[r].filter("is_poison").select("ord", "text").withColumn("rate", F.lit(r)) for r in wide if r is not None], docs.limit(0).select("ord", "text", F.lit(0.0).alias("rate")))
        key = F.concat_ws("#", "ord", "rate")
        made = dense_vectors(poison.select(key.alias("id"), "text"), "id").select(F.substring_index("id", "#", 1).cast("long").alias("ord"), F.substring_index("id", "#", -1).cast("double").alias("rate"), "v")
        vectors = clean.withColumn("rate", F.lit(None).cast("double")).unionByName(made)
        at = mine.join(F.broadcast(of), "f").withColumnRenamed("rate", "at").withColumnRenamed("ord", "o")
        at = at.join(vectors, (F.col("o") == F.col("ord")) & (F.col("rate").isNull() | (F.col("rate") == F.col("at"))))
        parts.append(select.penalised(at.drop("o", "at", "rate"), KEYS, k, select.manifold(clean)))
    columns = [*KEYS, "ord", "doc_id", "grp", "stance", "is_poison", "score"]
    chosen = cut(reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]))
    first = {c["retriever"]: c["cell_id"] for c in reversed(cells) if c["attack"] == "clean" and c["defense"] == "vanilla"}
    reference = spark.createDataFrame([(c["cell_id"], first[c["retriever"]]) for c in cells], "cell_id int, ref int")
    per_query = metrics.evaluate(chosen, F.broadcast(reference), docs, world["queries"], world["strata"], world["pool"], frame.filter("attack <> 'clean'").select("cell_id"))
    keyed = cut(per_query.join(F.broadcast(frame), "cell_id"))  # the grid is a driver-made list
    keys = ["attack", "poison_rate", "retriever", "defense", "epsilon"]
    return {"cells": frame, "per_query": keyed, "aggregate": metrics.means(keyed, keys), "by_stratum": metrics.means(keyed, [*keys, "stratum"])}


def controlled(spark: SparkSession, config: dict | None = None) -> DataFrame:
    """The means of the whole grid over the controlled corpus, which is made here."""
    world = corpus.controlled(spark)
    rows = [tuple(r) for r in world["docs"].orderBy("ord").collect()]  # the corpus is a fixed one of 1,824 passages
    poison = lambda rate: spark.createDataFrame(corpus.controlled_poison(rows, rate), corpus.DOCS)
    return run(spark, {**world, "poison": poison}, config)["aggregate"]
