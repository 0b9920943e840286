"""Registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph import storage
from kairograph.functions import text as T
from kairograph.operators import assistant, code, context, graph, keyword_index, ledger, render, retrieval, search, vector_index
from kairograph.sources import transcripts
from kairograph.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WHEN = "2024-01-15 00:00:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_type"), F.col("doc_id").alias("id_source"), F.col("text").alias("body"))


# --- ledger ---------------------------------------------------------------


@query("""SELECT doc_id, concat_ws(':', source, doc_id, substr(sha256(text), 1, 16)) AS episode_key, sha256(text) AS content_hash FROM documents""")
def ledger_episode_keys(spark, sf_dir):
    return ledger.with_keys(_documents(spark, sf_dir)).select("doc_id", "episode_key", "content_hash")


@query("""WITH k AS (SELECT doc_id, source, concat_ws(':', source, doc_id, substr(sha256(text), 1, 16)) AS episode_key, sha256(text) AS content_hash FROM documents)
SELECT doc_id, episode_key FROM k WHERE (episode_key, content_hash) NOT IN (SELECT (episode_key, content_hash) FROM k WHERE source = 'src0')""")
def ledger_skip_unchanged(spark, sf_dir):
    """All documents against a ledger of those of one source."""
    docs = ledger.with_keys(_documents(spark, sf_dir))
    done = docs.where("source_type = 'src0'").select("episode_key", "content_hash", F.lit(0).alias("ingested_at"))
    return ledger.not_ingested(docs, done).select("doc_id", "episode_key")


@query("""SELECT episode_key, ingested_at, event_id, value FROM (
SELECT concat_ws(':', event_type, user_id) AS episode_key, epoch_us(ts) AS ingested_at, event_id, value,
row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def ledger_latest_wins(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "user_id").alias("episode_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ingested_at"), "event_id", "value")
    return ledger.latest(rows)


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def exact_dedup_first(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return ledger.first_of_each(docs, "content_hash", "doc_id")


@query("""WITH k AS (SELECT page_id, 'kb/doc/' || (page_id // 2) AS episode_key, page_id % 2 = 1 AS old FROM pages)
SELECT episode_key, coalesce(min(page_id) FILTER (NOT old), min(page_id)) AS page_id FROM k GROUP BY 1""")
def ledger_key_migration(spark, sf_dir):
    """Keys that exist with slashes, with backslashes, or in both forms."""
    number = F.floor(F.col("page_id") / 2)
    slashes = F.concat(F.lit("kb/doc/"), number)
    rows = _t(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 1, F.translate(slashes, "/", "\\")).otherwise(slashes).alias("episode_key"), "page_id")
    return ledger.migrate_keys(rows)


@query("""WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS skipped FROM documents)
SELECT count(*) AS episodes, count(*) FILTER (skipped) AS skipped, sum(CASE WHEN skipped THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT AS nodes, sum(CASE WHEN skipped THEN 0 ELSE 1 END)::BIGINT AS edges FROM d""")
def ingest_totals(spark, sf_dir):
    """Totals of a batch in which copies of a content are skipped."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", T.content_hash(F.col("text")).alias("h"))
    first = docs.select("h", "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("new", F.lit(True))
    rows = docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines")).join(first, "doc_id", "left")
    new = F.col("new").isNotNull()
    return ledger.totals(rows.select((~new).alias("skipped"), F.when(new, F.col("lines")).otherwise(0).alias("nodes"), F.when(new, 1).otherwise(0).cast("long").alias("edges")))


# --- graph ----------------------------------------------------------------

_FACTS = "SELECT event_id, user_id, event_type, ts, value, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS expired_at FROM events"


def _event_facts(spark, sf_dir):
    return graph.with_expiry(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts", "event_id")


@query(f"""WITH f AS ({_FACTS}) SELECT event_id, user_id, event_type, value FROM f WHERE ts <= TIMESTAMP '{WHEN}' AND (expired_at IS NULL OR expired_at > TIMESTAMP '{WHEN}')""")
def asof_facts(spark, sf_dir):
    return graph.as_of(_event_facts(spark, sf_dir), F.to_timestamp_ntz(F.lit(WHEN)), "ts").select("event_id", "user_id", "event_type", "value")


@query(f"""WITH f AS ({_FACTS}) SELECT event_id, user_id, event_type, value FROM f WHERE ts <= TIMESTAMP '{WHEN}' AND expired_at > TIMESTAMP '{WHEN}'""")
def asof_facts_strict(spark, sf_dir):
    return graph.as_of(_event_facts(spark, sf_dir), F.to_timestamp_ntz(F.lit(WHEN)), "ts", strict_expired=True).select("event_id", "user_id", "event_type", "value")


@query("""WITH q AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'PR ' || (item_id % 7) ELSE 'sprint' || (item_id % 6) END || ': ' || text AS question FROM benchmark),
p(name, d) AS (VALUES ('pr1','2023-06-01'),('pr2','2023-12-01'),('pr3','2024-06-01'),('pr4','2024-12-01'),('sprint1','2023-03-01'),('sprint2','2023-06-01'),('sprint3','2023-09-01'),('sprint4','2023-12-01'))
SELECT item_id, d AS as_of FROM q LEFT JOIN p ON name = replace(lower(regexp_extract(question, '\\b(pr\\s*[0-9]+|sprint\\s*[0-9]+)\\b', 1, 'i')), ' ', '')""")
def asof_phase_inferred(spark, sf_dir):
    named = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("PR "), F.col("item_id") % 7)).otherwise(F.concat(F.lit("sprint"), F.col("item_id") % 6))
    questions = _t(spark, sf_dir, "benchmark").select("item_id", F.concat(named, F.lit(": "), F.col("text")).alias("question"))
    return questions.select("item_id", retrieval.phase_date(F.col("question")).cast("string").alias("as_of"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))""")
def label_filtered_edges(spark, sf_dir):
    labelled = _t(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(labelled, "o_custkey", "left_semi")


@query("""WITH o AS (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 20), n AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 40)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type,
CASE WHEN o.user_id IS NOT NULL AND n.user_id IS NOT NULL THEN 'reused' WHEN n.user_id IS NOT NULL THEN 'created' ELSE 'kept' END AS status
FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def graph_upsert_status(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return graph.upsert(events.where("value >= 20"), events.where("value < 40"), ["user_id", "event_type"])


@query("""WITH s AS (SELECT s_suppkey AS k, sha256('g|Supplier|' || s_suppkey) AS u FROM supplier WHERE s_acctbal > 0), p AS (SELECT p_partkey AS k, sha256('g|Part|' || p_partkey) AS u FROM part WHERE p_retailprice > 950)
SELECT l_orderkey, l_linenumber, s.u AS source_uuid, p.u AS target_uuid FROM lineitem JOIN s ON l_suppkey = s.k JOIN p ON l_partkey = p.k""")
def relation_resolution(spark, sf_dir):
    """Suppliers that deliver parts: both ends have to be known."""
    node = lambda t, label, key, mark: t.select(F.concat(F.lit(mark), key).alias("key"), graph.node_uuid(F.lit("g"), F.lit(label), F.col(key)).alias("uuid"))
    known = node(_t(spark, sf_dir, "supplier").where("s_acctbal > 0"), "Supplier", "s_suppkey", "s").unionByName(node(_t(spark, sf_dir, "part").where("p_retailprice > 950"), "Part", "p_partkey", "p"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("source_key"), F.concat(F.lit("p"), "l_partkey").alias("target_key"))
    return graph.resolve(lines, known).select("l_orderkey", "l_linenumber", "source_uuid", "target_uuid")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def dropped_relations(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source_key"), F.col("o_custkey").alias("target_key"))
    return graph.unresolved(orders, customers).select("o_orderkey")


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name = 'EUROPE' UNION SELECT b.b, w.depth + 1 FROM w JOIN b ON b.a = w.node WHERE w.depth < 2)
SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node""")
def khop_neighbourhood(spark, sf_dir):
    edge = lambda t, p, a, q, b: _t(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(a)).alias("a"), F.concat(F.lit(q), F.col(b)).alias("b"))
    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    seeds = _t(spark, sf_dir, "region").where("r_name = 'EUROPE'").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return graph.neighbourhood(edges, seeds, 2)


# --- retrieval ------------------------------------------------------------

_BM25 = """tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
st AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM tok),
wt AS (SELECT term, avgdl, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
sc AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN wt USING (term) JOIN asked USING (term) GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20)"""


_INDEXES: dict[tuple[str, str, str], str] = {}


def _indexed(spark, sf_dir, name, build):
    """The folder of an index over a table, which is built once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INDEXES:
        path = storage.shared_path(spark, name)
        build(path)
        _INDEXES[key] = path
    return _INDEXES[key]


def _bm25(spark, sf_dir):
    path = _indexed(spark, sf_dir, "words", lambda p: keyword_index.add(_t(spark, sf_dir, "documents").select("doc_id", "text"), p, "documents"))
    return keyword_index.search(spark, path, _t(spark, sf_dir, "benchmark"))


def _hits(spark, sf_dir):
    """The hits as a table of known size (20 rows a question), for joins with whole tables."""
    return storage.staged(_bm25(spark, sf_dir), "hits")


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM bm")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


_COS = """cs AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 10)"""


@query(f"WITH {_COS} SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM cs")
def cosine_topk(spark, sf_dir):
    """The query set is every vector whose id 50 divides, against all vectors."""
    vectors = _t(spark, sf_dir, "embeddings")
    path = _indexed(spark, sf_dir, "vectors", lambda p: vector_index.build(vectors, p))
    return vector_index.search(spark, path, vectors.where("vec_id % 50 = 0"))


_ASKED = "q AS (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN DATE '2023-06-01' WHEN 2 THEN DATE '2023-12-01' ELSE DATE '2024-06-01' END AS as_of FROM benchmark)"
_HYBRID = f"""f AS (SELECT conv_id * 1000 + turn AS doc_id, text, DATE '2023-01-01' + (conv_id % 500)::INTEGER AS valid_at, CASE WHEN turn % 3 > 0 THEN DATE '2023-01-01' + (conv_id % 500 + 200)::INTEGER END AS expired_at, role || (conv_id % 97) AS node FROM conversations),
ft AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM f),
qt AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM q),
ok AS (SELECT item_id, doc_id FROM q, f WHERE as_of IS NULL OR (valid_at <= as_of AND (expired_at IS NULL OR expired_at > as_of))),
asked AS (SELECT DISTINCT item_id, unnest(w) AS term FROM qt),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM ft) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
st AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM ft),
wt AS (SELECT term, avgdl, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
sc AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN wt USING (term) JOIN asked USING (term) JOIN ok USING (item_id, doc_id) GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20),
fe AS (SELECT doc_id, list_transform(range(256), lambda b: len(list_filter(w, lambda x: ('0x' || substr(md5(x), 1, 2))::INTEGER = b))::DOUBLE) AS v FROM ft WHERE len(w) > 0),
qe AS (SELECT item_id, list_transform(range(256), lambda b: len(list_filter(w, lambda x: ('0x' || substr(md5(x), 1, 2))::INTEGER = b))::DOUBLE) AS v FROM qt WHERE len(w) > 0),
vs AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(qe.v, fe.v), 6) DESC, doc_id) AS rank FROM qe JOIN ok USING (item_id) JOIN fe USING (doc_id)) WHERE rank <= 20),
bs AS (SELECT item_id, node, min(rank) AS seed FROM bm JOIN f USING (doc_id) WHERE rank <= 3 GROUP BY 1, 2),
gr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY seed, doc_id) AS rank FROM bs JOIN f USING (node) JOIN ok USING (item_id, doc_id)) WHERE rank <= 20),
u AS (SELECT item_id, doc_id, rank FROM bm UNION ALL SELECT item_id, doc_id, rank FROM vs UNION ALL SELECT item_id, doc_id, rank FROM gr),
fu AS (SELECT item_id, doc_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2)"""


@query(f"""WITH {_ASKED}, {_HYBRID} SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM fu) WHERE rank <= 20""")
def hybrid_topk(spark, sf_dir):
    """Turns of conversations as facts that hold for a time, asked by the benchmark's items, some at a date."""
    facts = _facts(spark, sf_dir)
    path = _indexed(spark, sf_dir, "facts", lambda p: search.index(facts, p))
    return search.hybrid(spark, path, facts, _questions(spark, sf_dir))


def _facts(spark, sf_dir):
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    born = F.col("conv_id") % 500
    name = F.element_at(F.array(*[F.lit(x) for x in ("lie", "prend une Décision", "Action", "a un risque", "REUNION")]), (F.col("turn") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", day(born).alias("valid_at"), F.when(F.col("turn") % 3 > 0, day(born + 200)).alias("expired_at"),
        F.concat("role", F.col("conv_id") % 97).alias("node"), name.alias("name"),
    )


def _questions(spark, sf_dir):
    at = F.when(F.col("item_id") % 4 == 1, "2023-06-01").when(F.col("item_id") % 4 == 2, "2023-12-01").when(F.col("item_id") % 4 == 3, "2024-06-01").cast("date")
    return _t(spark, sf_dir, "benchmark").select("item_id", "text", at.alias("as_of"))


_FRESH = "fr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS rank FROM bm JOIN documents USING (doc_id)))"


def _legs(spark, sf_dir):
    words = _hits(spark, sf_dir)
    short = words.select("item_id", "doc_id").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return [words, short.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")))]


@query(f"""WITH {_BM25}, {_FRESH}, u AS (SELECT item_id, doc_id, rank FROM bm UNION ALL SELECT item_id, doc_id, rank FROM fr),
f AS (SELECT item_id, doc_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f) WHERE rank <= 20""")
def rrf_fusion(spark, sf_dir):
    """A leg by BM25 and one that prefers short texts among its candidates."""
    return retrieval.fuse(_legs(spark, sf_dir), "item_id", "doc_id")


def _reranked(spark, sf_dir):
    docs, asked = _t(spark, sf_dir, "documents").select("doc_id", "text"), _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return retrieval.rerank(_hits(spark, sf_dir).join(docs, "doc_id").join(asked, "item_id"))


@query(f"""WITH {_BM25}, qa AS (SELECT item_id, list_distinct(list(term)) AS q FROM asked GROUP BY 1),
r AS (SELECT item_id, doc_id, rank, round(len(list_intersect(q, w))::DOUBLE / len(q), 6) AS rerank_score FROM bm JOIN qa USING (item_id) JOIN tok USING (doc_id))
SELECT * FROM (SELECT item_id, doc_id, rerank_score, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank)::INTEGER AS new_rank FROM r) WHERE new_rank <= 8""")
def rerank_topn(spark, sf_dir):
    return _reranked(spark, sf_dir).select("item_id", "doc_id", "rerank_score", "new_rank")


@query(f"""WITH {_BM25} SELECT item_id, l.quality, count(*) AS n FROM bm JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def ranked_by_label(spark, sf_dir):
    return _hits(spark, sf_dir).join(_t(spark, sf_dir, "labels"), "doc_id").groupBy("item_id", "quality").agg(F.count(F.lit(1)).alias("n"))


# --- context --------------------------------------------------------------


@query("""SELECT CASE WHEN contains(n, 'decision') OR contains(n, 'décision') THEN 'decision' WHEN contains(n, 'action') THEN 'action' WHEN contains(n, 'risk') OR contains(n, 'risque') THEN 'risk'
WHEN contains(n, 'meeting') OR contains(n, 'reunion') OR contains(n, 'réunion') THEN 'meeting' ELSE 'fact' END AS class, count(*) AS n_facts
FROM (SELECT lower(CASE event_type WHEN 'error' THEN 'Risk' WHEN 'purchase' THEN 'Transaction' WHEN 'signup' THEN 'Decision' ELSE event_type END) AS n FROM events) GROUP BY 1""")
def classify_facts(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "error", "Risk").when(kind == "purchase", "Transaction").when(kind == "signup", "Decision").otherwise(kind)
    return _t(spark, sf_dir, "events").groupBy(context.classify(name).alias("class")).agg(F.count(F.lit(1)).alias("n_facts"))


@query("""SELECT doc_id, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f]+'), lambda x: x <> '')) * 1.3::DOUBLE))::INTEGER AS tokens FROM documents""")
def token_estimates(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH t AS (SELECT conv_id, role, turn, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE))::INTEGER AS tokens FROM conversations),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, role ORDER BY turn)::BIGINT AS used FROM t) SELECT conv_id, role, turn, used FROM u WHERE used <= 300""")
def context_prefix_per_section(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "role", "turn", T.token_estimate(F.col("text")).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where("used <= 300").select("conv_id", "role", "turn", "used")


_TOKENS = "greatest(1, floor(len(list_filter(regexp_split_to_array({}, '[\\s\\x1c-\\x1f]+'), lambda x: x <> '')) * 1.3::DOUBLE))::INTEGER"
_EARLY = _ASKED.replace("CASE item_id % 4", "CASE WHEN item_id % 7 = 3 THEN DATE '2001-01-01' ELSE CASE item_id % 4").replace("END AS as_of", "END END AS as_of")


@query(f"""WITH RECURSIVE {_EARLY}, {_HYBRID},
hy AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fu) WHERE rank <= 20),
rr AS (SELECT item_id, doc_id, rank, round(len(list_intersect(list_distinct(qt.w), ft.w))::DOUBLE / greatest(len(list_distinct(qt.w)), 1), 6) AS score FROM hy JOIN qt USING (item_id) JOIN ft USING (doc_id)),
rk AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS rank FROM rr) WHERE rank <= 8),
en AS (SELECT item_id, rk.rank, CASE (doc_id % 1000) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS s,
 '- ' || f.text || chr(10) || '  _(date: ' || strftime(f.valid_at, '%Y-%m-%d') || ', source: graph:' || doc_id || ')_' AS entry FROM rk JOIN f USING (doc_id)),
xs AS (SELECT item_id, s, entry, ['## Faits', '## Décisions', '## Actions', '## Réunions', '## Risques'][s + 1] AS h, 2 AS ht, {_TOKENS.format("entry")} AS t, row_number() OVER (PARTITION BY item_id ORDER BY s, rank) AS k FROM en),
sp(item_id, k, used, txt, n, s, opened, filled, done) AS (SELECT item_id, 0::BIGINT, {_TOKENS.format("'## Question' || chr(10) || text")}, '## Question' || chr(10) || text, 0, -1, false, false, false FROM q WHERE item_id IN (SELECT item_id FROM xs)
 UNION ALL SELECT item_id, k, CASE WHEN fits THEN used + charge + t ELSE used END, CASE WHEN fits AND o THEN txt || chr(10) || entry WHEN fits THEN txt || chr(10) || chr(10) || h || chr(10) || entry ELSE txt END,
 n + fits::INTEGER, s, o OR fits, fu OR NOT fits, d
 FROM (SELECT *, NOT d AND NOT fu AND used + charge + t <= 3000 AS fits FROM (SELECT *, CASE WHEN o THEN 0 ELSE ht END AS charge FROM
 (SELECT sp.item_id, xs.k, used, txt, n, xs.s, t, entry, h, ht, xs.s = sp.s AND opened AS o, CASE WHEN xs.s <> sp.s THEN false ELSE filled END AS fu, done OR (xs.s <> sp.s AND used + ht >= 3000) AS d FROM sp JOIN xs ON xs.item_id = sp.item_id AND xs.k = sp.k + 1)))),
en2 AS (SELECT item_id, max_by(txt, k) AS context, max_by(used, k) AS used, max_by(n, k) AS n FROM sp GROUP BY 1)
SELECT q.item_id, q.text AS question, coalesce(context, 'Aucun contexte disponible dans le graphe de connaissances.') AS context, coalesce(used, 0) AS used, coalesce(n, 0) AS included FROM q LEFT JOIN en2 USING (item_id)""")
def context_pack(spark, sf_dir):
    """The context of every benchmark question: hybrid search at its date, reranked, classified and packed; the fixed text where nothing holds."""
    facts = _facts(spark, sf_dir)
    path = _indexed(spark, sf_dir, "facts", lambda p: search.index(facts, p))
    asked = _questions(spark, sf_dir).withColumn("as_of", F.when(F.col("item_id") % 7 == 3, F.lit("2001-01-01").cast("date")).otherwise(F.col("as_of")))
    return assistant.contexts(facts, asked, search=lambda own, asked: search.hybrid(spark, path, own, asked))


# --- sources and rendering ------------------------------------------------


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, array_to_string(list_sort(list_distinct(list(role))), ', ') AS participants, count(*) AS segments FROM conversations GROUP BY 1""")
def transcript_assembly(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.lit(None).cast("string").alias("ts"), F.col("role").alias("speaker"), "text")
    return transcripts.assemble(rows, "conv_id")


@query("""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(html, '<[^>]*>'), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM pages""")
def html_to_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT page_id, 'confluence_' || substr(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 80) || '.json' AS file_name FROM pages""")
def sink_file_names(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.file_name(F.lit("confluence"), F.col("url")).alias("file_name"))


@query("""SELECT page_id, '[Page ' || page_id || '](' || regexp_replace(url, '[.,;)]+$', '') || ')' AS link FROM pages""")
def source_links(spark, sf_dir):
    said = F.concat(F.lit("Page "), F.col("page_id"), F.lit(" — "), F.col("url"))
    return _t(spark, sf_dir, "pages").select("page_id", T.as_link(said).alias("link"))


@query("""WITH d AS (SELECT doc_id, chr(10) || '# ' || source || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang || ' | 2 |' || chr(10) || '- ' || n_chars || chr(10) || '---' || chr(10) || text AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, CASE WHEN trim(line) = '' OR regexp_matches(trim(line), '^-{3,}$') OR regexp_matches(line, '^\\s*\\|[\\s:|-]+\\|\\s*$') THEN NULL
WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN 'heading' WHEN regexp_matches(line, '^\\s*[-*]\\s+\\S') THEN 'bullet' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' ELSE 'paragraph' END AS kind FROM l) WHERE kind IS NOT NULL GROUP BY 1""")
def markdown_blocks(spark, sf_dir):
    """Documents as pages with a heading, a table and a list before the text."""
    page = F.concat(F.lit("\n# "), "source", F.lit("\n| a | b |\n|---|---|\n| "), "lang", F.lit(" | 2 |\n- "), "n_chars", F.lit("\n---\n"), "text")
    found = render.blocks(_t(spark, sf_dir, "documents").select("doc_id", page.alias("text")), "doc_id", "text")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""WITH e AS (SELECT event_id, event_type, unnest(['k', 'u' || (user_id % 5), 'v' || (event_id % 3)]) AS k, generate_subscripts(['k', 'u', 'v'], 1) AS pos FROM events),
f AS (SELECT event_type, k, min(event_id * 10 + pos) AS first FROM e GROUP BY 1, 2) SELECT event_type, list(k ORDER BY first) AS header FROM f GROUP BY 1""")
def union_header(spark, sf_dir):
    """Objects of several shapes; keys come in the order in which they first appear."""
    key = lambda prefix, n: F.concat(F.lit(f', "{prefix}'), n, F.lit('": 1'))
    props = F.concat(F.lit('{"k": 1'), key("u", F.col("user_id") % 5), key("v", F.col("event_id") % 3), F.lit("}"))
    return render.union_keys(_t(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "event_type", props.alias("props")), "event_type", "props")


# --- code -----------------------------------------------------------------


def _relations(spark, sf_dir):
    """Suppliers publish to parts' brands, which customers' nations receive: relations drawn from the tables."""
    lines = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    brands = lines.join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    nations = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name", "s_nationkey")
    sent = brands.join(nations, "l_suppkey").select("n_name", "s_nationkey", "p_brand").distinct()
    return sent.select(F.col("n_name").alias("source_component"), F.concat("p_brand", F.lit("Event")).alias("target"), F.when(F.col("s_nationkey") < 12, "publie").otherwise("consomme").alias("kind"), F.lit("t").alias("source_file"), F.lit(1).alias("line"))


_SENT = "s AS (SELECT DISTINCT n_name, n_nationkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"


@query(f"""WITH {_SENT} SELECT DISTINCT a.n_name AS publisher, a.p_brand || 'Event' AS event, b.n_name AS consumer FROM s a JOIN s b ON a.p_brand = b.p_brand WHERE a.n_nationkey < 12 AND b.n_nationkey >= 12""")
def code_event_flow(spark, sf_dir):
    return code.event_flow(_relations(spark, sf_dir))


@query(f"""WITH {_SENT}, r AS (SELECT n_name, 'c_' || regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') AS c, 'e_' || regexp_replace(p_brand || 'Event', '[^A-Za-z0-9_]', '_', 'g') AS e, p_brand || 'Event' AS t, CASE WHEN n_nationkey < 12 THEN 'publie' ELSE 'consomme' END AS kind FROM s)
SELECT n_name AS system, 'flowchart LR' || chr(10) || '  ' || min(c) || '["' || n_name || '"]' || chr(10) || string_agg('  ' || e || '{{{{"' || t || '"}}}}', chr(10) ORDER BY t) || chr(10) || string_agg('  ' || c || ' -->|' || kind || '| ' || e, chr(10) ORDER BY t) AS diagram FROM r GROUP BY n_name""")
def mermaid_system(spark, sf_dir):
    """A diagram for each nation."""
    return code.mermaid(_relations(spark, sf_dir).withColumn("system", F.col("source_component")))


# --- streams and relational coverage --------------------------------------


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, sf_dir):
    rows = ingest.tumbling(_t(spark, sf_dir, "events"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    rows = ingest.sessions(_t(spark, sf_dir, "events"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouping_sets(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    sets = rows.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("g"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered FROM customer""")
def semi_anti(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey")
    keys = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(keys, "c_custkey", "left_semi").withColumn("ordered", F.lit(True)).unionByName(customers.join(keys, "c_custkey", "left_anti").withColumn("ordered", F.lit(False)))


@query("""(SELECT DISTINCT c_nationkey AS k, 'both' AS side FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier))
UNION ALL (SELECT DISTINCT c_nationkey, 'customers' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier))""")
def set_operations(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers")))


@query("""SELECT o_orderkey, ntile(4) OVER w AS quarter, first_value(o_totalprice) OVER w AS first_price, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), 4) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    moving = F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.first("o_totalprice").over(w).alias("first_price"), moving.alias("moving"))


@query("""WITH i AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id FROM events WHERE event_type = 'signup')
SELECT e.event_id, i.event_id AS signup_id FROM events e JOIN i ON e.user_id = i.user_id AND e.ts >= i.a AND (i.b IS NULL OR e.ts < i.b) WHERE e.event_type = 'purchase'""")
def asof_join(spark, sf_dir):
    """Each purchase with the last signup before it: signups become intervals, then an equi-join with a range condition."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    spans = graph.with_expiry(events.where("event_type = 'signup'"), ["user_id"], "ts", "event_id").select("user_id", F.col("ts").alias("a"), F.col("expired_at").alias("b"), F.col("event_id").alias("signup_id"))
    bought = events.where("event_type = 'purchase'")
    return bought.join(spans, "user_id").where((F.col("ts") >= F.col("a")) & (F.col("b").isNull() | (F.col("ts") < F.col("b")))).select("event_id", "signup_id")
