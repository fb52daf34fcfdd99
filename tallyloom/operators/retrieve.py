"""Lexical, hashed, embedding and sparse retrieval with stable top-k.

Every retriever scores all queries at once; top_k() orders by score, then corpus order. Lexical,
hashed and sparse scores are one thing, a product of sparse vectors: documents keep to the one
shuffle that counts their terms, queries come to them as a matrix if they are few enough (checked),
and only k rows per query leave a partition. bm25() and sparse_scores() give all scores, for
statistics over whole rankings and for query sets that are too large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_tokens, fnv1a, hash_place, hash_sign, tokens
from ..session import ship

K1, B = 1.5, 0.75
WIDTH = 512


def top_k(scored: DataFrame, keys: list[str], k: int, score: str = "score", tie: str = "ord") -> DataFrame:
    """Rows of rank 1..k per key, by score descending, then ``tie``; adds ``rnk``. A limit is pushed
    below the shuffle, so at most k rows per key and task are exchanged. Null and NaN scores are
    not ranked."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    kept = scored.filter(F.col(score).isNotNull() & ~F.isnan(score))
    return kept.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k)


def fetch_size(k: int) -> int:
    """How many are fetched ahead of re-ranking."""
    return max(3 * k, k + 5)


def postings(docs: DataFrame) -> DataFrame:
    """(term, ord, tf) of all documents; texts without tokens have none."""
    return docs.select("ord", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "ord").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("ord", F.size(F.coalesce(tokens(F.col("text")), F.array())).cast("long").alias("len"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(distinct_tokens(F.col("text"))).alias("term"))


#: Rows of (query, term) up to which they are broadcast; beyond, they are joined by shuffle.
FEW_TERMS = 200_000


def small_side(df: DataFrame, most: int = FEW_TERMS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which is counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def distinct_texts(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, same): one (qid, text) per distinct text, and (qid, to) from it to all its queries."""
    texts = queries.groupBy("text").agg(F.min("qid").alias("qid")).select("qid", "text")
    same = queries.select(F.col("qid").alias("to"), "text").join(texts, "text").select("qid", "to")
    return texts, same


def to_all(rows: DataFrame, same: DataFrame) -> DataFrame:
    """Results of distinct texts, given to every query with that text."""
    return rows.join(small_side(same), "qid").drop("qid").withColumnRenamed("to", "qid")


def lexical_parts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ord, term, w): each document's BM25 part of every term of ``wanted`` (term) it holds.

    Tokens that are no query term are dropped ahead of the only large shuffle, which is by document;
    counting and weighting then stay inside its partitions.
    """
    counted = docs.select("ord", tokens(F.col("text")).alias("ts"))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.coalesce("ts", F.array()))).alias("avg_len"))
    terms = small_side(wanted.select("term").distinct())
    long = counted.select("ord", F.size("ts").alias("len"), F.explode("ts").alias("term")).join(terms, "term", "left_semi")
    held = long.repartition("ord").groupBy("ord", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    df = terms.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")  # at most a row per query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_len")  # stats: one row
    weights = F.broadcast(weights) if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS else weights
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return held.join(weights, "term").select("ord", "term", part.alias("w"))


def bm25_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, ord, score) of documents that hold a query term: all of them. Sums stay inside the
    partitions of lexical_parts(), and so does a top-k's first limit."""
    wanted = query_terms(texts)
    return sparse_scores(lexical_parts(docs, wanted), wanted.withColumn("w", F.lit(1.0)), "term")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, ord, score) for every query; queries with equal texts are scored once."""
    texts, same = distinct_texts(queries)
    return to_all(bm25_texts(docs, texts), same).select("qid", "ord", "score")


def top_by_text(docs: DataFrame, queries: DataFrame, k: int, kind: str = "bm25", zeros: bool = False) -> DataFrame:
    """(qid, rnk, ord, score): top-k of each distinct text, given to all its queries."""
    texts, same = distinct_texts(queries)
    top = sparse_top_k(*vectors_of(kind)(docs, texts), k)
    if zeros:
        top = with_zeros(top, docs, texts, k)
    return to_all(top, same).select("qid", "rnk", "ord", "score")


def with_zeros(top: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Fill rankings (qid, rnk, ord, score) of fewer than k rows up with documents without a match,
    score 0, in corpus order. A ranking that short holds all matches of its query, so the first 2k
    documents of the corpus are enough."""
    found = top.groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    short = queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("found", F.lit(0)).alias("found")).filter(F.col("found") < k)
    first = docs.select("ord").orderBy("ord").limit(2 * k)
    zeros = short.crossJoin(F.broadcast(first)).join(top.select("qid", "ord"), ["qid", "ord"], "left_anti")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("ord")) + F.col("found")
    zeros = zeros.withColumn("rnk", place.cast("int")).filter(F.col("rnk") <= k)
    return top.select("qid", "rnk", "ord", "score").unionByName(zeros.select("qid", "rnk", "ord", F.lit(0.0).alias("score")))


def hash_embed(docs: DataFrame, key: str = "ord", width: int = WIDTH) -> DataFrame:
    """(key, idx, w): signed feature hashing of tokens, L2-normalised; all-zero rows are absent.
    Only distinct words are hashed, then joined back."""
    long = docs.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    words = long.select("term").distinct().withColumn("h", fnv1a(F.col("term")))
    words = words.select("term", hash_place(F.col("h"), width).alias("idx"), hash_sign(F.col("h")).alias("sign"))
    cells = long.join(words, "term").groupBy(key, "idx").agg(F.sum(F.col("sign") * F.col("tf")).alias("v")).filter(F.col("v") != 0)
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return cells.select(key, "idx", (F.col("v") / norm).alias("w"))


def to_dense(rows: DataFrame, cells: DataFrame, key: str = "ord", width: int = WIDTH) -> DataFrame:
    """(key, v) for every row of ``rows``: the sparse (key, idx, w) as arrays, zeros without cells."""
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
    return rows.select(key).join(maps, key, "left").select(key, filled.alias("v"))


def sparse_scores(doc_vectors: DataFrame, query_vectors: DataFrame, term: str = "idx") -> DataFrame:
    """(qid, ord, score): all dot products of sparse vectors (ord, term, w) and (qid, term, w) that
    share a term. Documents that are already together by ord stay so where the queries are few."""
    q = small_side(query_vectors.select("qid", term, F.col("w").alias("wq")))
    return doc_vectors.join(q, term).groupBy("ord", "qid").agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("score")).select("qid", "ord", "score")


#: Numbers of a query matrix that a task holds at once (8 bytes each); more queries come in blocks.
MATRIX = 4_000_000


def sparse_top_k(doc_vectors: DataFrame, query_vectors: DataFrame, k: int, term: str = "term") -> DataFrame:
    """(qid, ord, score, rnk): top-k by dot product of sparse vectors (ord, term, w) and (qid, term, w),
    over the documents that share a term with the query.

    Query vectors up to FEW_TERMS rows (counted) are a matrix in every task: documents, together by
    ord, are multiplied where they are, and k rows per query and task are shuffled. More of them
    are joined by term.
    """
    rows = query_vectors.select("qid", term, F.col("w").cast("double").alias("w")).limit(FEW_TERMS + 1).toPandas()
    if len(rows) > FEW_TERMS:
        return top_k(sparse_scores(doc_vectors, query_vectors, term), ["qid"], k).select("qid", "ord", "score", "rnk")
    ship(doc_vectors.sparkSession)
    qids, terms = np.sort(rows["qid"].unique()), np.sort(rows[term].unique())
    at_q, at_t, weight = np.searchsorted(qids, rows["qid"]), np.searchsorted(terms, rows[term]), rows["w"].to_numpy(float)
    names = doc_vectors.sparkSession.createDataFrame([(t.item() if hasattr(t, "item") else t, n) for n, t in enumerate(terms)], f"`{term}` {query_vectors.schema[term].dataType.simpleString()}, j int")
    kind, of = query_vectors.schema["qid"].dataType.simpleString(), doc_vectors.schema["ord"].dataType.simpleString()
    # at most FEW_TERMS names; rows of a document are together already
    lists = doc_vectors.join(F.broadcast(names), term).groupBy("ord").agg(F.collect_list(F.struct("j", F.col("w").cast("double").alias("w"))).alias("r"))
    width, block = len(terms), max(1, MATRIX // max(len(terms), 1))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_score, best_ord = np.full((len(qids), 0), -np.inf), np.zeros((len(qids), 0), dtype=np.int64)
        parts = []
        for start in range(0, len(qids), block):
            mine = (at_q >= start) & (at_q < start + block)
            q = np.zeros((width, min(block, len(qids) - start)))
            np.add.at(q, (at_t[mine], at_q[mine] - start), weight[mine])
            parts.append((start, q, (q != 0).astype(np.float32)))
        for whole in batches:
            for offset in range(0, whole.num_rows, 512):
                batch = whole.slice(offset, 512)
                lists = batch.column(1)
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(sizes)), sizes)
                d = np.zeros((len(sizes), width))
                np.add.at(d, (row, flat.field(0).to_numpy()), flat.field(1).to_numpy())
                ords = batch.column(0).to_numpy()
                shares = (d != 0).astype(np.float32)
                scores = np.concatenate([np.where(shares @ m > 0, np.round(d @ q, 9), -np.inf) for _, q, m in parts], axis=1).T
                places = np.broadcast_to(ords, scores.shape)
                best_score, best_ord = _best(np.concatenate([best_score, scores], axis=1), np.concatenate([best_ord, places], axis=1), k)
        found = np.isfinite(best_score)
        which = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(qids[which].tolist()), pa.array(best_ord[found]), pa.array(best_score[found])], schema=pa.schema([("qid", pa.string() if kind == "string" else pa.int64()), ("ord", pa.int64()), ("score", pa.float64())]))

    if not len(qids):
        return lists.sparkSession.createDataFrame([], f"qid {kind}, ord {of}, score double, rnk int")
    return top_k(lists.mapInArrow(multiply, f"qid {kind}, ord {of}, score double"), ["qid"], k)


def sparse_encode(df: DataFrame, key: str, most: int = 256) -> DataFrame:
    """(key, term, w): a deterministic stand-in for a sparse encoder: ln(1 + tf), the ``most``
    heaviest terms of each row, ties by term."""
    long = df.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.log1p(F.count(F.lit(1))).alias("w"))
    order = Window.partitionBy(key).orderBy(F.col("w").desc(), "term")
    return long.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(key, "term", "w")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of doubles, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors that a task holds at once; more are packed into blocks.
FEW_VECTORS = 20_000


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(qid, ord, score, rnk): exact top-k of every query against every vector, by dot product.

    Up to FEW_VECTORS queries (counted) are a matrix in every task; vectors (ord, v) are multiplied
    where they are, without a shuffle, and k rows per query and task leave it. More queries are
    packed into blocks of about ``block`` rows, as are the vectors, and each pair of blocks is one
    product. Null vectors are left out.
    """
    ship(vectors.sparkSession)
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, ord {vectors.schema['ord'].dataType.simpleString()}, score double"
    asked = queries.filter(F.col("v").isNotNull()).select("qid", F.col("v").cast("array<double>").alias("v"))
    own = vectors.filter(F.col("v").isNotNull()).select("ord", F.col("v").cast("array<double>").alias("v"))
    few = asked.limit(FEW_VECTORS + 1).toPandas()
    if len(few) <= FEW_VECTORS:
        if not len(few):
            return vectors.sparkSession.createDataFrame([], kinds + ", rnk int")
        qids, matrix = few["qid"].to_numpy(), np.stack(few["v"])

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score, place = np.full((len(qids), 0), -np.inf), np.zeros((len(qids), 0), dtype=np.int64)
            for whole in batches:
                for at in range(0, len(whole), 2048):
                    batch = whole.iloc[at : at + 2048]
                    new = np.round(matrix @ np.stack(batch["v"]).T, 9)
                    score, place = _best(np.concatenate([score, new], axis=1), np.concatenate([place, np.broadcast_to(batch["ord"].to_numpy(), new.shape)], axis=1), k)
            yield pd.DataFrame({"qid": np.repeat(qids, score.shape[1]), "ord": place.ravel(), "score": score.ravel()})

        return top_k(own.mapInPandas(multiply, kinds), ["qid"], k)
    n = -(-queries.count() // block)
    left = own.select(F.floor(F.col("ord") / block).alias("lb"), F.struct("ord", "v").alias("r")).groupBy("lb").agg(F.collect_list("r").alias("ls"))
    right = asked.select(F.pmod(F.xxhash64("qid"), F.lit(n)).alias("rb"), F.struct("qid", "v").alias("r")).groupBy("rb").agg(F.collect_list("r").alias("rs"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ls, rs in zip(batch["ls"], batch["rs"], strict=True):
                ords, qids = np.array([x["ord"] for x in ls]), [x["qid"] for x in rs]
                scores = np.round(np.stack([x["v"] for x in rs]) @ np.stack([x["v"] for x in ls]).T, 9)
                score, place = _best(scores, np.broadcast_to(ords, scores.shape), k)
                yield pd.DataFrame({"qid": np.repeat(np.array(qids, dtype=object), score.shape[1]), "ord": place.ravel(), "score": score.ravel()})

    return top_k(left.crossJoin(right).select("ls", "rs").mapInPandas(pairs, kinds), ["qid"], k)


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, by score, then place."""
    if scores.shape[1] > 4 * k:
        # the k-th best score of a row is a safe floor: ties stay in until the exact order
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = int((scores >= least).sum(axis=1).max())
        pick = np.argsort(-scores, axis=1, kind="stable")[:, : max(keep, k)]
        scores, places = np.take_along_axis(scores, pick, 1), np.take_along_axis(places, pick, 1)
    order = np.lexsort((places, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)


Encoder = Callable[[list[str]], np.ndarray]


def encode(df: DataFrame, key: str, text: str, encoder: Encoder, prefix: str = "", batch: int = 256) -> DataFrame:
    """(key, v): vectors of distinct texts, each encoded once, joined back to all rows.

    ``encoder`` maps a list of texts to a matrix; it is built into the task, so a model is loaded
    once per worker. ``prefix`` is put before every text.
    """
    ship(df.sparkSession)
    distinct = df.select(F.concat(F.lit(prefix), F.col(text)).alias("t")).filter(F.col("t").isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows["t"].iloc[at : at + batch].tolist()
                yield pd.DataFrame({"t": part, "v": list(np.asarray(encoder(part), dtype=np.float64))})

    vectors = distinct.mapInPandas(run, "t string, v array<double>")
    return df.select(key, F.concat(F.lit(prefix), F.col(text)).alias("t")).join(vectors, "t").select(key, "v")


def replace_vectors(vectors: DataFrame, override: DataFrame, key: str = "ord") -> DataFrame:
    """Vectors with those of ``override`` put in place of their own; a vector for an unknown row is
    a ValueError."""
    if not override.join(vectors, key, "left_anti").isEmpty():
        raise ValueError("override has rows that the vectors lack")
    new = override.select(key, F.col("v").alias("new"))
    return vectors.join(new, key, "left").select(key, F.coalesce("new", "v").alias("v"))


def vectors_of(kind: str) -> Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """A function (docs, queries) -> sparse vectors (ord, term, w), (qid, term, w) by retriever name;
    an unknown name is a ValueError."""

    def lexical(docs: DataFrame, queries: DataFrame):
        wanted = query_terms(queries)
        return lexical_parts(docs, wanted), wanted.withColumn("w", F.lit(1.0))

    def hashed(docs: DataFrame, queries: DataFrame):
        return tuple(hash_embed(x, key).withColumnRenamed("idx", "term") for x, key in ((docs, "ord"), (queries, "qid")))

    makers = {"bm25": lexical, "dense": hashed, "splade": lambda d, q: (sparse_encode(d, "ord"), sparse_encode(q, "qid"))}
    if kind not in makers:
        raise ValueError(f"unknown retriever {kind!r}")
    return makers[kind]


def build_retriever(kind: str, encoder: Encoder | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function (docs, queries) -> (qid, ord, score) of all scores by name; ``st`` takes an encoder
    and scores dense vectors. An unknown name is a ValueError."""
    if kind == "st":
        if encoder is None:
            raise ValueError("retriever 'st' needs an encoder")
        return lambda d, q: vector_top_k(encode(d, "ord", "text", encoder), encode(q, "qid", "text", encoder), fetch_size(10)).drop("rnk")
    make = vectors_of(kind)
    return lambda d, q: sparse_scores(*make(d, q), "term")
