"""Hybrid search over facts that are indexed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph import storage
from kairograph.operators import keyword_index, retrieval, vector_index


def index(facts: DataFrame, path: str, *, embed=retrieval.hashed_embedding) -> None:
    """Writes the keyword and the vector index of facts ``doc_id, text, valid_at, expired_at, node`` below a folder."""
    own = retrieval.dated(facts)
    keyword_index.add(own, f"{path}/words", "facts", lower="low", upper="high")
    vector_index.build(own.select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding"), "low", "high"), f"{path}/vectors", lower="low", upper="high")


def hybrid(spark: SparkSession, path: str, facts: DataFrame, questions: DataFrame, n: int = retrieval.RETRIEVED, *, embed=retrieval.hashed_embedding, seeds: int = 3) -> DataFrame:
    """The result of ``retrieval.hybrid``; two legs read what the indexes keep of the questions' terms and of their vectors' surroundings."""
    asked = retrieval.asked_at(questions)
    words = storage.staged(keyword_index.search(spark, f"{path}/words", asked, n, at="at"), "word_hits")  # they are used twice; n rows a question
    near = vector_index.search(spark, f"{path}/vectors", asked.select(F.col("item_id").alias("vec_id"), embed(F.col("text")).alias("embedding"), "at"), n, own=True, at="at")
    return retrieval.hybrid(facts, questions, n, seeds=seeds, words=words, near=near)
