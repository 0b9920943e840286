"""Keyword and vector legs, fusion and reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The usual constants of BM25 and of reciprocal rank fusion, and how many candidates the two rankings keep.
K1, B = 1.2, 0.75
RRF_K = 60
RETRIEVED, RERANKED = 20, 8
#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4096
#: Questions whose terms are broadcast at once.
QUESTION_BLOCK = 2048

# Phase names in questions and the dates they stand for.
PHASES = (
    ("pr1", "2023-06-01"), ("pr2", "2023-12-01"), ("pr3", "2024-06-01"), ("pr4", "2024-12-01"),
    ("sprint1", "2023-03-01"), ("sprint2", "2023-06-01"), ("sprint3", "2023-09-01"), ("sprint4", "2023-12-01"),
)


def phase_date(question: Column) -> Column:
    """The date of the first phase that a question names, null without a known one."""
    name = F.regexp_replace(F.lower(F.regexp_extract(question, r"(?i)\b(pr\s*[0-9]+|sprint\s*[0-9]+)\b", 1)), " ", "")
    table = F.create_map(*[F.lit(x) for k, d in PHASES for x in (k, d)])
    return F.try_element_at(table, name).cast("date")


def terms(text: Column) -> Column:
    """Words of a text, lower-cased; none of a null one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ascii_ = F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same, which Java's engine tests far faster
    return F.array_remove(F.when(F.octet_length(low) == F.length(low), ascii_).otherwise(F.split(low, r"[^\p{L}\p{N}]+")), "")


def top(scored: DataFrame, by: str, item: str, n: int, score: str = "score") -> DataFrame:
    """The n best items per ``by`` with ``rank``; ties by item. Each task keeps n per group before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def term_weights(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, idf, avgdl`` of the vocabulary's terms that some document has; a document counts once for a term before anything moves."""
    bag = docs.select(terms(F.col("text")).alias("w"))
    size = bag.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("w")).alias("avgdl"))
    df = bag.select(F.explode(F.array_distinct("w")).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(size)).select("term", idf.alias("idf"), "avgdl")  # size has one row


def bm25(docs: DataFrame, questions: DataFrame, n: int = RETRIEVED, *, lower: str | None = None, upper: str | None = None, at: str | None = None) -> DataFrame:
    """``item_id, doc_id, score, rank`` of the best documents per question.

    Questions go in blocks of QUESTION_BLOCK, whose terms and weights are broadcast (a block's questions
    hold some thousand terms). Each task scores its documents against a whole block, as a sparse
    product, and keeps n per question, so that no pair of document and question is shuffled.
    ``at`` names a question's number that has to be in a document's [``lower``, ``upper``), null being open.
    """
    spark = docs.sparkSession
    bounds = [F.col(c).cast("double").alias(k) if c else F.lit(None).cast("double").alias(k) for k, c in (("low", lower), ("high", upper))]
    moment = F.col(at).cast("double") if at else F.lit(None).cast("double")
    asked = questions.select("item_id", moment.alias("at"), F.array_distinct(terms(F.col("text"))).alias("w"))
    blocks = max(1, -(-questions.count() // QUESTION_BLOCK))
    vocabulary = asked.select(F.explode("w").alias("term")).distinct()
    weights = term_weights(docs, vocabulary).persist()
    rows = docs.select("doc_id", *bounds, terms(F.col("text")).alias("w"))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        own = weights.join(part.select(F.explode("w").alias("term")).distinct(), "term", "left_semi").collect()
        items = part.collect()
        number = {r["term"]: i for i, r in enumerate(own)}
        pairs = [(number[t], q) for q, r in enumerate(items) for t in r["w"] if t in number]
        pairs.sort()
        shared = spark.sparkContext.broadcast((
            number, np.array([r["idf"] for r in own]), own[0]["avgdl"] if own else 1.0, np.array([t for t, _ in pairs], dtype=np.int64), np.array([q for _, q in pairs], dtype=np.int64),
            [r["item_id"] for r in items], np.array([np.nan if r["at"] is None else r["at"] for r in items], dtype=np.float64)))
        scored = rows.mapInPandas(_scored(shared, n), f"item_id {dict(questions.dtypes)['item_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score double")
        found = scored if found is None else found.unionByName(scored)
    weights.unpersist()
    return top(found, "item_id", "doc_id", n)


def _scored(shared, n: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, idf, avgdl, terms_, asked, items, at = shared.value
        first = np.searchsorted(terms_, np.arange(len(idf) + 1))
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.iloc[start : start + 512]
                row, term, length = [], [], np.array([len(w) for w in batch["w"]], dtype=np.float64)
                for i, w in enumerate(batch["w"]):
                    here = [k for x in w if (k := number.get(x)) is not None]
                    row.append(np.full(len(here), i))
                    term.append(np.array(here, dtype=np.int64))
                code, tf = np.unique(np.concatenate(row) * max(1, len(idf)) + np.concatenate(term), return_counts=True)
                i, t = np.divmod(code, max(1, len(idf)))
                part = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[i] / avgdl)) if len(code) else np.zeros(0)
                many = first[t + 1] - first[t]
                at_q = asked[np.repeat(first[t], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                total = np.bincount(np.repeat(i, many) * len(items) + at_q, weights=np.repeat(part, many), minlength=len(batch) * len(items)).reshape(len(batch), len(items)) if len(items) else np.zeros((len(batch), 0))
                total = np.where(total > 0, np.round(total, 6), -np.inf)
                total[outside(batch, at)] = -np.inf
                yield best(total, np.array(items), batch["doc_id"].to_numpy(), n, "item_id", "doc_id")

    return score


def outside(batch: pd.DataFrame, at: np.ndarray) -> np.ndarray:
    """Pairs of rows and questions whose moment is outside of the row's [low, high); nulls are open."""
    low, high = (batch[c].to_numpy(dtype=np.float64)[:, None] for c in ("low", "high"))
    return (at[None, :] < low) | (at[None, :] >= high)


def best(score: np.ndarray, columns: np.ndarray, rows: np.ndarray, n: int, column: str, row: str) -> pd.DataFrame:
    """The n best finite scores of each column, ties by row."""
    order = np.lexsort((np.broadcast_to(rows[:, None], score.shape), -score), axis=0)[:n]
    at = np.broadcast_to(np.arange(score.shape[1]), order.shape)
    keep = np.isfinite(score[order, at])
    return pd.DataFrame({column: columns[at[keep]], row: rows[order[keep]], "score": score[order, at][keep]})


def comparable(embedding: Column) -> Column:
    """Whether a vector has a direction: not null nor zero, and without null or non-finite components."""
    v = embedding.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine_search(vectors: DataFrame, queries: DataFrame, n: int = 10, *, own: bool = False, lower: str | None = None, upper: str | None = None, at: str | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank``: the nearest vectors of each query vector, exactly; its own number only if ``own``.

    Vectors that are null, zero, have a null or non-finite component, or another
    length than the query's, are not compared, on either side. Queries go in blocks of QUERY_BLOCK vectors of a length, each a
    matrix that is broadcast; tasks multiply their batches with it and keep n per query. ``at``, ``lower``, ``upper``: as in ``bm25``.
    """
    spark = vectors.sparkSession
    fine = comparable(F.col("embedding"))
    moment = F.col(at).cast("double") if at else F.lit(None).cast("double")
    asked = queries.where(fine).select("vec_id", "embedding", moment.alias("at"), F.size("embedding").alias("dim")).persist()
    bounds = [F.col(c).cast("double").alias(k) if c else F.lit(None).cast("double").alias(k) for k, c in (("low", lower), ("high", upper))]
    rows = vectors.where(fine).select("vec_id", "embedding", *bounds)
    found = None
    for dim, count in asked.groupBy("dim").count().collect():  # few lengths
        blocks = -(-count // QUERY_BLOCK)
        for b in range(blocks):
            part = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).collect()
            if not part:
                continue
            q = np.array([r["embedding"] for r in part], dtype=np.float64)
            shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in part]), q / np.linalg.norm(q, axis=1)[:, None], np.array([np.nan if r["at"] is None else r["at"] for r in part])))
            near = rows.where(F.size("embedding") == dim).mapInPandas(_nearest(shared, n, own), "query_id long, vec_id long, score double")
            found = near if found is None else found.unionByName(near)
    asked.unpersist()
    if found is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return top(found, "query_id", "vec_id", n)


def _nearest(shared, n: int, own: bool):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, at = shared.value
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack(batch["embedding"].tolist()).astype(np.float64)
            vec = batch["vec_id"].to_numpy()
            score = np.round((v / np.linalg.norm(v, axis=1)[:, None]) @ q.T, 6)
            if not own:
                score[vec[:, None] == ids[None, :]] = -np.inf
            score[outside(batch, at)] = -np.inf
            yield best(score, ids, vec, n, "query_id", "vec_id")

    return search


DIMENSIONS = 256


def _hashed(words: pd.Series) -> pd.Series:
    def one(xs) -> np.ndarray:
        return np.bincount([hashlib.md5(x.encode()).digest()[0] for x in xs], minlength=DIMENSIONS).astype(np.float32)

    return words.map(one)


def hashed_embedding(text: Column) -> Column:
    """The embedding used where no model is configured: counts of a text's terms by the first byte of their MD5."""
    return F.pandas_udf(_hashed, "array<float>")(terms(text))


def dated(facts: DataFrame) -> DataFrame:
    """Facts ``doc_id, text, node`` with ``low`` and ``high``, the seconds between which they hold; null is open."""
    return facts.select("doc_id", "text", "node", _second("valid_at").alias("low"), _second("expired_at").alias("high"))


def _second(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")


def asked_at(questions: DataFrame) -> DataFrame:
    """Questions ``item_id, text`` with ``at``, the second that they ask for; null is any."""
    return questions.select("item_id", "text", _second("as_of").alias("at"))


def hybrid(facts: DataFrame, questions: DataFrame, n: int = RETRIEVED, *, embed=hashed_embedding, seeds: int = 3, words: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """``item_id, doc_id, score, rank``: keyword, vector and graph legs over the facts that hold at each question's date, fused.

    Facts are ``doc_id, text, valid_at, expired_at, node`` and questions ``item_id, text, as_of`` (null: any time). A
    fact holds in [valid_at, expired_at), open where null. The graph leg has the facts that share a node
    with one of the ``seeds`` best keyword hits, by the hit's rank and then by number. ``words`` and ``near`` are the
    first two legs, where an index answers them (``search.hybrid``).
    """
    own, asked = dated(facts), asked_at(questions)
    bounds = {"lower": "low", "upper": "high", "at": "at"}
    words = bm25(own, asked, n, **bounds) if words is None else words
    if near is None:
        near = cosine_search(
            own.select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding"), "low", "high"),
            asked.select(F.col("item_id").alias("vec_id"), embed(F.col("text")).alias("embedding"), "at"), n, own=True, **bounds,
        )
    best = words.where(F.col("rank") <= seeds).join(own.select("doc_id", "node"), "doc_id").groupBy("item_id", "node").agg(F.min("rank").alias("seed"))
    best = best.where(F.col("node").isNotNull()).join(asked.select("item_id", F.coalesce("at", F.lit(float("inf"))).alias("at")), "item_id")
    # the n first facts of a node are found once for each date, not for each question, and move as n a task
    linked = best.select("node", "at").distinct().join(own.select("doc_id", "node", "low", "high"), "node")
    whenever = F.col("at") == float("inf")
    linked = linked.where(whenever | ((F.col("low").isNull() | (F.col("low") <= F.col("at"))) & (F.col("high").isNull() | (F.col("high") > F.col("at")))))
    first = linked.withColumn("k", F.row_number().over(Window.partitionBy("node", "at").orderBy("doc_id"))).where(F.col("k") <= n)
    graph = top(best.join(first, ["node", "at"]).groupBy("item_id", "doc_id").agg(F.max(-F.col("seed")).alias("score")), "item_id", "doc_id", n)
    return fuse([words, near.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank"), graph], "item_id", "doc_id", n)


def fuse(legs: list[DataFrame], by: str, item: str, n: int = RETRIEVED) -> DataFrame:
    """Reciprocal rank fusion of legs ``by, item, rank``."""
    union = legs[0].select(by, item, "rank")
    for leg in legs[1:]:
        union = union.unionByName(leg.select(by, item, "rank"))
    scored = union.groupBy(by, item).agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top(scored, by, item, n)


def overlap(question: Column, text: Column) -> Column:
    """Share of a question's distinct terms that a text has: the scorer used where no model is configured."""
    q = F.array_distinct(terms(question))
    return F.round(F.size(F.array_intersect(q, terms(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def best_scores(ranked: DataFrame, by: str = "item_id", score: str = "rerank_score") -> DataFrame:
    """The best score and the number of candidates of each question."""
    return ranked.groupBy(by).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("candidates"))


def rerank(candidates: DataFrame, n: int = RERANKED, scorer=overlap) -> DataFrame:
    """Candidates ``item_id, question, doc_id, text, rank`` by the scorer, ties by their former rank."""
    order = Window.partitionBy("item_id").orderBy(F.desc("rerank_score"), F.asc("rank"))
    scored = candidates.withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= n)
