"""The subpackage's queries and their SQL, by name; ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_packing, cover_tree, decontaminate, lang_id, line_dedup, lm_score, pii, secret_scan, simhash_dedup, source_audit, spelling, substring_dedup, warc
from ._shared import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read_table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(read_table(spark, sf_dir, "documents")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_repeated(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return cut.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), gone.alias("removed_bytes"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read_table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return cut.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_lang_id": op2_lang_id,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_lm_score": op5_lm_score,
        "op6_warc": op6_warc,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_cover_tree": op9_cover_tree,
        "op10_decontaminate": op10_decontaminate,
        "op11_source_audit": op11_source_audit,
        "op12_spelling": op12_spelling,
        "op13_substring_dedup": op13_substring_dedup,
    }


#: The archives' records follow from the pages alone; the round trip through bundles must not change them.
_WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
t AS (SELECT page_id, payload, CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS target FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
CASE WHEN target IS NULL OR page_id IS NOT DISTINCT FROM target THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to FROM t"""

_LINKS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN d ON a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": _WARC_SQL, "op9_cover_tree": _LINKS_SQL, "op11_source_audit": source_audit.SQL, "op13_substring_dedup": substring_dedup.SQL}
