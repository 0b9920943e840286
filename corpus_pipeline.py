"""A corpus from raw documents to packed training sequences, in stages over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import bin_packing, decontaminate, lang_id, line_dedup, simhash_dedup
from kairograph.llm._shared import read_table, staged

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without letters, or of doubtful language, go."""
    names = docs.columns
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    seen = lang_id.predict(docs.withColumn("__row", F.struct(*names)).select("__row", "text"), model)
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand earlier in the corpus; n_chars (if there) follows the text. Documents of which nothing is left go."""
    names = docs.columns
    others = F.struct(*[c for c in names if c != "text"]).alias("row")
    cut = line_dedup.remove_repeated(docs.select("doc_id", "text", others))
    left = cut.where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "int"))}
    return left.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null after all others, then by row order) of each group of near-duplicates.

    Rows are numbered where doc_ids are null or repeated, so that each is decided for itself."""
    rows, rid = line_dedup.numbered(docs, "doc_id")
    found = simhash_dedup.near_duplicates(rows.select(rid.alias("__id"), "text"), key="__id").withColumnRenamed("doc_id", "__id")
    if rows is docs:
        stay = found.where(F.col("__id") == F.col("component_id"))
    else:
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__id")).alias("x")
        stay = found.join(rows.select(rid.alias("__id"), "doc_id"), "__id").groupBy("component_id").agg(least).select("x.__id")
    return rows.join(stay, rid == stay["__id"], "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return bin_packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express hashed n-grams, rolling hashes or a tokenizer; tests hold each stage against a plain version or planted passages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
