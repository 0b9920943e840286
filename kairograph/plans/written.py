"""Registered queries over what the library writes and projects: graph, episodes, sources, code, documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kairograph import schemas, storage
from kairograph.functions import text as T
from kairograph.operators import code, context, graph, ledger, modules, render, retrieval, writer
from kairograph.plans.queries import _BM25, _documents, _indexed, _reranked, _t, query
from kairograph.sources import records, transcripts

# --- graph and episodes ---------------------------------------------------


def _extractions(spark, sf_dir):
    """Each conversation as an extraction: its speakers are entities of two types, and each turn a relation to the one before; some name nobody."""
    turns = _t(spark, sf_dir, "conversations")
    key = F.concat("role", F.lit("-"), F.col("conv_id") % 50)
    kind = F.when(F.col("turn") % 2 == 0, "Person").otherwise("Application")
    text = F.lit(None).cast("string")
    entity = F.struct(key.alias("key"), kind.alias("type"), F.substring("text", 1, 20).alias("name"), text.alias("summary"), text.alias("attrs"))
    other = F.when(F.col("turn") % 7 == 6, "nobody").otherwise(F.concat(F.lit("user-"), F.col("conv_id") % 50))
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("conv_id") % 500).cast("int")).cast("timestamp")
    relation = F.struct(key.alias("source_key"), other.alias("target_key"), F.when(F.col("turn") % 3 > 0, "parle").alias("name"), F.substring("text", 1, 10).alias("fact"), day.alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entity.alias("e"), relation.alias("r")))).alias("x"))  # of one conversation
    return rows.select("conv_id", F.concat(F.lit("conv:"), "conv_id").alias("source_ref"), F.transform("x", lambda t: t["e"]).alias("entities"), F.transform("x", lambda t: t["r"]).alias("relations"))


def _graph(spark, sf_dir):
    """The folder of the graph: odd conversations are written first, then even ones, then the odd ones again, and the log is compacted in between."""

    def build(path):
        rows = _extractions(spark, sf_dir)
        for part in (1, 0, 1):
            writer.write_graph(rows.where(F.col("conv_id") % 2 == part).drop("conv_id"), path)
            if not part:
                writer.compact_graph(spark, path)

    return _indexed(spark, sf_dir, "graph", build)


_EXTRACTED = """t AS (SELECT *, 'conv:' || conv_id AS source_ref, role || '-' || (conv_id % 50) AS key, CASE WHEN turn % 2 = 0 THEN 'Person' ELSE 'Application' END AS type,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
nd AS (SELECT *, sha256('default|' || type || '|' || key) AS uuid FROM t),
ends AS (SELECT source_ref, key, max_by(uuid, pos) AS uuid FROM nd GROUP BY ALL),
rel AS (SELECT source_ref, conv_id, key AS source_key, CASE WHEN turn % 7 = 6 THEN 'nobody' ELSE 'user-' || (conv_id % 50) END AS target_key, CASE WHEN turn % 3 > 0 THEN 'parle' END AS name, substr(text, 1, 10) AS fact,
 (DATE '2023-01-01' + (conv_id % 500)::INTEGER)::TIMESTAMP AS valid_at FROM t),
ed AS (SELECT DISTINCT a.uuid AS source_uuid, b.uuid AS target_uuid, name, fact, valid_at, rel.source_ref FROM rel JOIN ends a ON a.source_ref = rel.source_ref AND a.key = source_key JOIN ends b ON b.source_ref = rel.source_ref AND b.key = target_key)"""


@query(f"""WITH {_EXTRACTED} SELECT uuid, type, key, name, source_ref FROM (SELECT uuid, type, key, substr(text, 1, 20) AS name, source_ref, row_number() OVER (PARTITION BY uuid ORDER BY conv_id % 2 DESC, source_ref DESC, pos DESC) AS n FROM nd) WHERE n = 1""")
def graph_nodes_written(spark, sf_dir):
    """Nodes after three transactions and a compaction: of a node the last write counts."""
    return writer.nodes(spark, _graph(spark, sf_dir)).select("uuid", "type", "key", "name", "source_ref")


@query(f"""WITH {_EXTRACTED} SELECT source_uuid, target_uuid, name, fact, valid_at, source_ref FROM ed""")
def graph_edges_written(spark, sf_dir):
    return writer.edges(spark, _graph(spark, sf_dir)).select("source_uuid", "target_uuid", "name", "fact", F.col("valid_at").cast("timestamp_ntz").alias("valid_at"), "source_ref")


@query(f"""WITH {_EXTRACTED} SELECT fact, name AS edge_name, count(*) AS n FROM ed GROUP BY ALL""")
def edge_candidates(spark, sf_dir):
    """Edges as search candidates, by what they say."""
    found = graph.candidates(writer.edges(spark, _graph(spark, sf_dir)))
    return found.groupBy("fact", "edge_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EXTRACTED}, whole AS (SELECT count(*) AS n FROM rel), kept AS (SELECT count(*) AS n FROM rel JOIN ends a ON a.source_ref = rel.source_ref AND a.key = source_key JOIN ends b ON b.source_ref = rel.source_ref AND b.key = target_key)
SELECT (SELECT count(*) FROM nd) AS nodes_reused, 0::BIGINT AS nodes_created, (SELECT n FROM kept) AS edges_created, (SELECT w.n - k.n FROM whole w, kept k) AS edges_dropped""")
def graph_counters(spark, sf_dir):
    """What writing all extractions once more would do, counted by a dry run."""
    return writer.write_graph(_extractions(spark, sf_dir).drop("conv_id"), _graph(spark, sf_dir), dry_run=True)


def _episodes(spark, sf_dir):
    """The folder of two batches of all documents; sources are their identifiers, so that equal texts of a source are one episode."""

    def build(path):
        docs = _documents(spark, sf_dir).select("doc_id", F.lit("document").alias("source_type"), F.col("source_type").alias("id_source"), F.concat(F.lit("T "), "source_type").alias("title"), "body")
        marks = [writer.ingest(docs.where(F.col("doc_id") % 2 == part), path, f"b{part}", order="doc_id").withColumn("batch", F.lit(f"b{part}")) for part in (0, 1)]
        marks[0].unionByName(marks[1]).write.parquet(f"{path}/marks")

    return _indexed(spark, sf_dir, "episodes", build)


_KEYED = "k AS (SELECT doc_id, source, 'b' || (doc_id % 2) AS batch, concat_ws(':', 'document', source, substr(sha256(text), 1, 16)) AS episode_key, sha256(text) AS content_hash, text, row_number() OVER (PARTITION BY 'document', source, substr(sha256(text), 1, 16) ORDER BY doc_id % 2, doc_id) AS copy FROM documents)"


@query(f"""WITH {_KEYED} SELECT episode_key, batch, copy > 1 AS skipped, count(*) AS n FROM k GROUP BY ALL""")
def ingest_marks(spark, sf_dir):
    """What a batch after another skips as seen before."""
    marks = spark.read.parquet(f"{_episodes(spark, sf_dir)}/marks")
    return marks.groupBy("episode_key", "batch", "skipped").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_KEYED} SELECT episode_key, content_hash, 'T ' || source AS name, length(text) AS size, 'document:' || source AS source_description, 'text' AS kind, 'default' AS group_id, batch FROM k WHERE copy = 1""")
def episodes_written(spark, sf_dir):
    rows = spark.read.schema(writer.EPISODES).parquet(f"{_episodes(spark, sf_dir)}/episodes")
    return rows.select("episode_key", "content_hash", "name", F.length("body").cast("long").alias("size"), "source_description", "kind", "group_id", "batch")


@query(f"""WITH {_KEYED} SELECT episode_key, content_hash FROM k WHERE copy = 1""")
def ledger_written(spark, sf_dir):
    rows = spark.read.schema(writer.LEDGER).parquet(f"{_episodes(spark, sf_dir)}/ledger")
    return ledger.latest(rows).select("episode_key", "content_hash")


@query("""WITH d AS (SELECT DISTINCT ts::DATE::TIMESTAMP AS as_of FROM events UNION SELECT DISTINCT o_orderdate::DATE::TIMESTAMP FROM orders), f AS (SELECT event_id, ts AS low, CASE WHEN event_id % 10 > 0 THEN ts + to_hours((event_id % 4000)::INTEGER) END AS high FROM events)
SELECT as_of, count(*) AS facts, min(event_id) AS first FROM d JOIN f ON low <= as_of AND (high IS NULL OR high > as_of) GROUP BY 1""")
def asof_many_dates(spark, sf_dir):
    """How many events hold at each day of an event or order: intervals and dates meet in bins."""
    ts = F.col("ts").cast("timestamp")
    facts = _t(spark, sf_dir, "events").select("event_id", ts.alias("valid_at"), F.when(F.col("event_id") % 10 > 0, ts + F.make_dt_interval(hours=(F.col("event_id") % 4000).cast("int"))).alias("expired_at"))
    day = lambda c: F.date_trunc("day", c).cast("timestamp").alias("as_of")
    dates = _t(spark, sf_dir, "orders").select(day("o_orderdate")).union(_t(spark, sf_dir, "events").select(day("ts"))).distinct()
    found = graph.as_of_many(facts, dates).groupBy("as_of").agg(F.count(F.lit(1)).alias("facts"), F.min("event_id").alias("first"))
    return found.select(F.col("as_of").cast("timestamp_ntz").alias("as_of"), "facts", "first")


# --- sources --------------------------------------------------------------


@query("""WITH c AS (SELECT l_orderkey, string_agg('[S' || l_suppkey || '] ' || l_returnflag, chr(10) || chr(10) ORDER BY l_linenumber, l_suppkey, l_returnflag) AS said, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'O-' || o_orderkey AS id_source, '[O-' || o_orderkey || '] ' || o_orderpriority AS title, concat_ws(chr(10) || chr(10), CASE WHEN o_orderkey % 3 > 0 THEN 'C' || o_custkey END, CASE WHEN n > 0 THEN '=== Commentaires ===' || chr(10) || said END,
 '=== Historique statuts ===' || chr(10) || strftime(o_orderdate, '%Y-%m-%d') || ' : None → ' || o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '=== Liens ===' || chr(10) || 'bloque : O-' || (o_orderkey + 1) END) AS body,
 CASE WHEN o_orderkey % 5 > 0 THEN 'R' || o_custkey ELSE 'A' || o_custkey END AS author, o_orderdate AS created_at, 'https://t.example/browse/O-' || o_orderkey AS url, coalesce(n, 0)::INTEGER AS comments, 1 AS status_changes, (o_orderkey % 2 = 0)::INTEGER AS links
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def ticket_documents(spark, sf_dir):
    """Orders as tickets, as a service's JSON: lines are comments, the status has a history, some have links."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_returnflag"))).alias("x"))  # an order's lines
    comments = F.transform("x", lambda c: F.struct(F.struct(F.concat(F.lit("S"), c["l_suppkey"]).alias("displayName")).alias("author"), c["l_returnflag"].alias("body")))
    person = lambda mark: F.struct(F.concat(F.lit(mark), "o_custkey").alias("displayName"))
    key = F.concat(F.lit("O-"), "o_orderkey")
    item = F.struct(F.lit("status").alias("field"), F.lit(None).cast("string").alias("fromString"), F.col("o_orderstatus").alias("toString"))
    other = F.struct(F.lit("priority").alias("field"), F.lit("a").alias("fromString"), F.lit("b").alias("toString"))
    link = F.struct(F.struct(F.lit("bloque").alias("name")).alias("type"), F.struct(F.concat(F.lit("O-"), F.col("o_orderkey") + 1).alias("key")).alias("outwardIssue"))
    fields = F.struct(
        F.col("o_orderpriority").alias("summary"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("C"), "o_custkey")).alias("description"), F.struct(F.col("o_orderstatus").alias("name")).alias("status"), person("A").alias("assignee"),
        F.when(F.col("o_orderkey") % 5 > 0, person("R")).alias("reporter"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'").alias("created"), F.struct(comments.alias("comments")).alias("comment"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(link)).alias("issuelinks"),
    )
    changes = F.struct(F.array(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.array(other, item).alias("items"))).alias("histories"))
    sent = _t(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(F.to_json(F.struct(key.alias("key"), fields.alias("fields"), changes.alias("changelog"))).alias("value"))
    issues = sent.select(F.from_json("value", records.ISSUE).alias("x")).select("x.*")
    found = records.tickets(issues, "https://t.example/")
    return found.select("id_source", "title", "body", "author", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "url", "comments", "status_changes", "links")


@query("""WITH c AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN '[' || role || '] ' ELSE '[?] ' END || 'oui & ' || turn, chr(10) || chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1)
SELECT page_id::VARCHAR AS id_source, CASE WHEN page_id % 4 > 0 THEN url ELSE '(sans titre)' END AS title, concat_ws(chr(10) || chr(10), 'a < b' || chr(10) || url, CASE WHEN said IS NOT NULL THEN '=== Commentaires ===' || chr(10) || said END) AS body, 'https://w.example/wiki/spaces/S/pages/' || page_id AS url FROM pages LEFT JOIN c ON conv_id = page_id""")
def wiki_documents(spark, sf_dir):
    """Pages with entities in their bodies, and turns of the conversation of the same number as comments."""
    body = F.concat(F.lit("<p>a &lt; b</p><!-- c --><b title='>'>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</b>"))
    pages = _t(spark, sf_dir, "pages").select(F.to_json(F.struct(F.col("page_id").cast("string").alias("id"), F.when(F.col("page_id") % 4 > 0, F.col("url")).alias("title"), F.struct(F.struct(body.alias("value")).alias("storage")).alias("body"))).alias("value"))
    pages = pages.select(F.from_json("value", records.PAGE).alias("x")).select("x.*")
    said = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("author"), F.concat(F.lit("<p>oui &amp; "), "turn", F.lit("</p>")).alias("value"))
    return records.wiki_pages(pages, said, url="https://w.example", space="S").select("id_source", "title", "body", "url")


@query("""SELECT event_id, ts AS iso, date_trunc('day', ts) AS pdf_day, date_trunc('second', ts) AS pdf_time, NULL::TIMESTAMP AS bad FROM events""")
def parsed_times(spark, sf_dir):
    """Times written as services and as PDF files write them."""
    rows = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    plain = lambda c: c.cast("timestamp_ntz")
    return rows.select(
        "event_id", plain(T.parse_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("iso"), plain(T.parse_pdf_date(F.date_format("ts", "'D:'yyyyMMdd"))).alias("pdf_day"),
        plain(T.parse_pdf_date(F.date_format("ts", "'D:'yyyyMMddHHmmss'+02''00'"))).alias("pdf_time"), plain(T.parse_iso(F.concat(F.lit("le "), "event_type"))).alias("bad"),
    )


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM pages""")
def stripped_labels(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("label"))


_FILE = "CASE page_id % 8 WHEN 0 THEN url || '.DOCX' WHEN 1 THEN url || '.xlsx' WHEN 2 THEN url || '.Md' WHEN 3 THEN url || '.puml' WHEN 4 THEN url || '.vtt' WHEN 5 THEN url || '.pdf' WHEN 6 THEN url || '.zip' ELSE 'plain' END"


@query(f"""SELECT page_id, row_number() OVER (PARTITION BY reader ORDER BY path, page_id)::INTEGER AS place, reader FROM (SELECT *, CASE WHEN path LIKE '%.DOCX' THEN 'docx' WHEN path LIKE '%.xlsx' THEN 'xlsx' WHEN path LIKE '%.Md' THEN 'obsidian' WHEN path LIKE '%.puml' THEN 'diagram'
WHEN path LIKE '%.vtt' THEN 'meeting' WHEN path LIKE '%.pdf' THEN 'pdf' END AS reader FROM (SELECT page_id, {_FILE} AS path FROM pages))""")
def routed_files(spark, sf_dir):
    """Files by suffix, each reader's numbered in the order of their names."""
    routed = records.route(_t(spark, sf_dir, "pages").select("page_id", F.expr(_FILE).alias("path")))
    return routed.select("page_id", F.row_number().over(Window.partitionBy("reader").orderBy("path", "page_id")).alias("place"), "reader")


@query("""SELECT lang, source, count(*) FILTER (lang IN ('en', 'fr')) AS fine, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'fr')) AS others FROM documents GROUP BY ALL""")
def quarantined_values(spark, sf_dir):
    """Rows inside a closed domain and in quarantine."""
    fine, others = schemas.quarantine(_t(spark, sf_dir, "documents"), "lang", ("en", "fr"))
    both = fine.withColumn("ok", F.lit(True)).unionByName(others.withColumn("ok", F.lit(False)))
    return both.groupBy("lang", "source").agg(F.count_if("ok").alias("fine"), F.count_if(~F.col("ok")).alias("others"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 't' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_ts FROM conversations""")
def last_times(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("t"), "turn")).alias("ts"))
    return transcripts.with_last_time(rows, "conv_id", "turn", "ts").select("conv_id", "turn", "last_ts")


@query("""SELECT item_id, array_to_string([x for x in list_transform(string_split('Decision, ' || substr(text, 1, 12) || ' ,, Action ', ','), lambda x: trim(x, ' ')) if x <> ''], ';') AS kinds, CASE WHEN item_id % 3 > 0 THEN make_date(2023, 1 + (item_id % 12)::INTEGER, 5)::TIMESTAMP END AS as_of FROM benchmark""")
def parsed_options(spark, sf_dir):
    """Options as users give them: a list of classes, and a date or nothing."""
    date = F.when(F.col("item_id") % 3 > 0, F.format_string("2023-%02d-05", (F.col("item_id") % 12 + 1).cast("int"))).otherwise("")
    kinds = T.comma_list(F.concat(F.lit("Decision, "), F.substring("text", 1, 12), F.lit(" ,, Action ")))
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(kinds, ";").alias("kinds"), T.as_of_date(date).cast("timestamp_ntz").alias("as_of"))


# --- answers and documents ------------------------------------------------


@query("""SELECT conv_id, turn, '- ' || substr(text, 1, 40) || chr(10) || '  _(' || CASE WHEN turn % 2 = 0 THEN 'date: 2024-01-0' || (1 + turn % 9) || ', ' ELSE '' END || 'source: ' || role || CASE WHEN turn % 3 = 0 THEN ' (p.' || turn || ')' ELSE '' END || ')_' AS entry FROM conversations""")
def context_entries(spark, sf_dir):
    date = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("2024-01-0"), F.col("turn") % 9 + 1)).otherwise("")
    entry = context.entry_text(F.substring("text", 1, 40), F.col("role"), F.when(F.col("turn") % 3 == 0, F.col("turn")).cast("int"), date)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", entry.alias("entry"))


@query("""SELECT doc_id, '# ' || source || chr(10) || chr(10) || '## Résumé' || chr(10) || lang || CASE WHEN n_chars % 2 = 0 THEN chr(10) || chr(10) || '## Faits' || chr(10) || '- un' || chr(10) || '- ' || n_chars ELSE '' END
|| CASE WHEN n_chars % 3 = 0 THEN chr(10) || chr(10) || '## Risques' || chr(10) || '- "r"' ELSE '' END || chr(10) || chr(10) || '## Sources' || chr(10) || CASE WHEN n_chars % 5 = 0 THEN '_Aucune source._' ELSE '- [Doc](https://d.example/' || doc_id || ')' END AS page FROM documents""")
def answer_pages(spark, sf_dir):
    """Answers of a model, some in a fence, as pages."""
    some = lambda cond, *xs: F.when(cond, F.array(*xs)).otherwise(F.expr("cast(array() as array<string>)"))
    n = F.col("n_chars")
    told = F.to_json(F.struct(
        F.col("lang").alias("resume"), some(n % 2 == 0, F.lit("un"), n.cast("string")).alias("facts"), some(F.lit(False), F.lit("")).alias("decisions"), some(F.lit(False), F.lit("")).alias("actions"),
        some(n % 3 == 0, F.lit('"r"')).alias("risks"), some(n % 5 != 0, F.concat(F.lit("Doc — https://d.example/"), "doc_id", F.lit("."))).alias("sources")))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Voici :\n```json\n"), told, F.lit("\n```\n"))).otherwise(told)
    found = render.answers(_t(spark, sf_dir, "documents").select("doc_id", "source", raw.alias("raw")))
    return found.select("doc_id", render.answer_markdown(F.col("source"), F.col("answer")).alias("page"))


@query("""SELECT doc_id, '| ' || array_to_string(list_transform([replace(substr(text, 1, 30), chr(10), '|'), lang, NULL], lambda x: replace(coalesce(x, ''), '|', '\\|')), ' | ') || ' |' AS line, CASE WHEN substr(text, 1, 31) = '' THEN 'Feuille1' ELSE substr(text, 1, 31) END AS sheet FROM documents""")
def table_lines(spark, sf_dir):
    cells = F.array(F.replace(F.substring("text", 1, 30), F.lit("\n"), F.lit("|")), F.col("lang"), F.lit(None).cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", T.table_row(cells).alias("line"), T.sheet_name(F.col("text")).alias("sheet"))


@query("""SELECT s_suppkey, s_suppkey || ';' || s_name || ';[' || s_nationkey || ',' || s_suppkey || '];' AS cells FROM supplier""")
def cell_texts(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.array(F.col("s_nationkey").cast("long"), "s_suppkey").alias("pair"), F.lit(None).cast("int").alias("none"))
    return render.table_rows(rows, "s_suppkey").select("s_suppkey", F.array_join("cells", ";").alias("cells"))


_PAGE = "SELECT conv_id, unnest(string_split(string_agg(CASE WHEN turn % 3 = 0 THEN '## ' || role ELSE '- ' || turn END || chr(10) || '| a | ' || turn || ' |' || chr(10) || '|---|---|' || chr(10) || '| b | c |', chr(10) ORDER BY turn), chr(10))) AS line, generate_subscripts(string_split(string_agg(CASE WHEN turn % 3 = 0 THEN '## ' || role ELSE '- ' || turn END || chr(10) || '| a | ' || turn || ' |' || chr(10) || '|---|---|' || chr(10) || '| b | c |', chr(10) ORDER BY turn), chr(10)), 1) - 1 AS pos FROM conversations GROUP BY conv_id"


@query(f"""WITH l AS ({_PAGE}), k AS (SELECT *, CASE WHEN line LIKE '## %' THEN 'heading' WHEN line LIKE '- %' THEN 'bullet' ELSE 'table' END AS kind FROM l WHERE line NOT LIKE '|---%'),
b AS (SELECT *, sum((kind <> 'table' OR before IS DISTINCT FROM 'table')::INTEGER) OVER (PARTITION BY conv_id ORDER BY pos) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM k)),
g AS (SELECT conv_id, min(pos) AS pos, kind, list(line ORDER BY pos) AS lines FROM b GROUP BY conv_id, block, kind)
SELECT conv_id, pos::INTEGER AS pos, kind, array_to_string(lines, chr(10)) AS text, sum((lines[1] LIKE '## %')::INTEGER) OVER (PARTITION BY conv_id ORDER BY pos)::BIGINT AS section FROM g""")
def numbered_blocks(spark, sf_dir):
    """Conversations as pages of headings, lists and tables: their blocks, numbered by section."""
    line = F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## "), "role")).otherwise(F.concat(F.lit("- "), "turn")), F.lit("\n| a | "), "turn", F.lit(" |\n|---|---|\n| b | c |"))
    pages = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("page"))  # of one conversation
    found = render.numbered_sections(render.grouped_blocks(pages, "conv_id", "page"), "conv_id")
    return found.select("conv_id", "pos", "kind", F.array_join("lines", "\n").alias("text"), "section")


@query(f"""WITH {_BM25}, qa AS (SELECT item_id, list_distinct(list(term)) AS q FROM asked GROUP BY 1),
r AS (SELECT item_id, doc_id, rank, round(len(list_intersect(q, w))::DOUBLE / len(q), 6) AS rerank_score FROM bm JOIN qa USING (item_id) JOIN tok USING (doc_id)),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank) AS new_rank FROM r) WHERE new_rank <= 8)
SELECT item_id, max(rerank_score) AS best, count(*) AS candidates, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM x JOIN documents USING (doc_id) GROUP BY 1""")
def rerank_scores(spark, sf_dir):
    """Reranked candidates carry what they came with; the best score of each question."""
    best = storage.staged(_reranked(spark, sf_dir).select("item_id", "doc_id", "rerank_score"), "reranked")  # 8 rows a question, used twice
    ranked = best.join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sources = ranked.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return retrieval.best_scores(ranked).join(sources, "item_id")


# --- code -----------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(name), 'publish|emit|dispatch|fire|raise|send|produce') THEN 'publie' WHEN regexp_matches(lower(name), 'subscribe|consume|listen|on|addlistener|register|handle') THEN 'consomme' END AS kind, name LIKE '%Event' AS event
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'rePublish' WHEN 1 THEN 'sendOn' WHEN 2 THEN p_type WHEN 3 THEN 'OnHandle' || p_size ELSE p_brand || 'Event' END AS name FROM part)""")
def call_kinds(spark, sf_dir):
    name = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'rePublish' WHEN 1 THEN 'sendOn' WHEN 2 THEN p_type WHEN 3 THEN concat('OnHandle', p_size) ELSE concat(p_brand, 'Event') END")
    return _t(spark, sf_dir, "part").select("p_partkey", code.call_kind(name).alias("kind"), name.endswith("Event").alias("event"))


def _classes(spark, sf_dir):
    """Each supplier as a class of its nation's module, which publishes what it sold returned, receives its nation's event, and depends on its region."""
    sold = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("Flag"), "l_returnflag", F.lit("Event")))).alias("published"))  # three flags
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(sold, "s_suppkey", "left")
    none = F.expr("cast(array() as array<string>)")
    line = F.col("s_suppkey").cast("int") * 10
    return rows.select(
        F.concat(F.lit("/src/"), "n_name", F.lit(".py")).alias("path"), F.col("n_name").alias("module"), F.concat(F.lit("S"), "s_suppkey").alias("class"), line.alias("line"), F.coalesce("published", none).alias("published"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.concat("n_name", F.lit("Event")))).otherwise(none).alias("subscribed"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.concat(F.lit("R"), "n_regionkey"))).otherwise(none).alias("dependencies"),
        (line + 5).alias("line_end"), F.lit("class").alias("kind"), F.array(F.lit("run")).alias("methods"), F.lit("python").alias("language"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("package"),
    )


_CLASSES = """sold AS (SELECT l_suppkey, list_sort(list(DISTINCT 'Flag' || l_returnflag || 'Event')) AS published FROM lineitem GROUP BY 1),
c AS (SELECT '/src/' || n_name || '.py' AS path, n_name AS module, 'S' || s_suppkey AS class, (s_suppkey * 10)::INTEGER AS line, coalesce(published, []) AS published, CASE WHEN s_suppkey % 2 = 0 THEN [n_name || 'Event'] ELSE [] END AS subscribed,
 CASE WHEN s_suppkey % 3 = 0 THEN ['R' || n_regionkey] ELSE [] END AS dependencies, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS package FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN sold ON l_suppkey = s_suppkey),
safe AS (SELECT *, regexp_replace(module, '[^A-Za-z0-9_]', '_', 'g') AS sm FROM c),
nodes AS (SELECT module, text, min(line * 100 + place) AS first FROM (
 SELECT module, line, 0 AS place, '  c_' || class || '["' || class || '"]' AS text FROM safe
 UNION ALL SELECT module, line, 10 + generate_subscripts(published, 1), '  e_' || unnest(published) || '{{"' || unnest(published) || '"}}' FROM safe
 UNION ALL SELECT module, line, 20, '  e_' || sm || 'Event{{"' || subscribed[1] || '"}}' FROM safe WHERE len(subscribed) > 0
 UNION ALL SELECT module, line, 30, '  d_' || dependencies[1] || '(["' || dependencies[1] || '"])' FROM safe WHERE len(dependencies) > 0) GROUP BY ALL),
edges AS (SELECT module, line * 100 + 10 + generate_subscripts(published, 1) AS pos, '  c_' || class || ' -->|publie| e_' || unnest(published) AS text FROM safe
 UNION ALL SELECT module, line * 100 + 20, '  e_' || sm || 'Event -->|consommé par| c_' || class FROM safe WHERE len(subscribed) > 0
 UNION ALL SELECT module, line * 100 + 30, '  c_' || class || ' -.->|appelle| d_' || dependencies[1] FROM safe WHERE len(dependencies) > 0),
dia AS (SELECT module, 'flowchart LR' || chr(10) || n || chr(10) || e AS diagram FROM (SELECT module, string_agg(text, chr(10) ORDER BY first) AS n FROM nodes GROUP BY 1) JOIN (SELECT module, string_agg(text, chr(10) ORDER BY pos) AS e FROM edges GROUP BY 1) USING (module))"""


@query(f"""WITH {_CLASSES} SELECT class AS source_component, unnest(published) AS target, 'publie' AS kind, path AS source_file, line, 0.7::DOUBLE AS confidence FROM c
UNION ALL SELECT class, subscribed[1], 'consomme', path, line, 0.7 FROM c WHERE len(subscribed) > 0 UNION ALL SELECT class, dependencies[1], 'appelle', path, line, 0.5 FROM c WHERE len(dependencies) > 0""")
def code_candidates(spark, sf_dir):
    return code.relations(_classes(spark, sf_dir))


@query(f"""WITH {_CLASSES} SELECT module, coalesce(diagram, '') AS diagram FROM (SELECT DISTINCT module FROM c) LEFT JOIN dia USING (module)""")
def module_diagrams(spark, sf_dir):
    return modules.modules(_classes(spark, sf_dir)).select("module", modules.diagram().alias("diagram"))


_MODULES = """m AS (SELECT module, path, any_value(package) AS package, list(class ORDER BY line) AS classes, list('`' || path || ':' || line || '-' || (line + 5) || ' (' || class || ')`' ORDER BY line) AS sources, list_sort(list_distinct(flatten(list(published)))) AS unordered FROM c GROUP BY module, path),
ev AS (SELECT module, list(e ORDER BY first) AS published FROM (SELECT module, e, min(line * 10 + place) AS first FROM (SELECT module, line, unnest(published) AS e, generate_subscripts(published, 1) AS place FROM c) GROUP BY ALL) GROUP BY 1),
sb AS (SELECT module, list(DISTINCT subscribed[1]) AS subscribed FROM c WHERE len(subscribed) > 0 GROUP BY 1)"""


@query(f"""WITH {_CLASSES}, {_MODULES} SELECT module AS module_name, path AS file_path, package, array_to_string(classes, ',') AS classes, array_to_string(coalesce(published, []), ',') AS published, array_to_string(coalesce(subscribed, []), ',') AS subscribed, array_to_string(list_transform(sources, lambda x: replace(x, '`', '')), ',') AS sources
FROM m LEFT JOIN ev USING (module) LEFT JOIN sb USING (module)""")
def module_facts(spark, sf_dir):
    """Base documents of modules, written as payloads and read back."""
    sent = modules.payloads(modules.base(modules.modules(_classes(spark, sf_dir))))
    found = modules.completed(sent)
    joined = lambda c, alias: F.array_join(c, ",").alias(alias)
    return found.select("module_name", "file_path", "package", joined("classes", "classes"), joined("events_published", "published"), joined("events_subscribed", "subscribed"), joined("sources", "sources"))


@query(f"""WITH {_CLASSES}, {_MODULES} SELECT module AS module_name, concat_ws(chr(10), '---', 'module: ' || module, 'language: python', 'package: ' || package, 'tags: [code, python, reverse-engineering]', '---' || chr(10), '# ' || module || chr(10),
'## Description fonctionnelle' || chr(10) || chr(10) || '_Aucune description générée._' || chr(10), CASE WHEN diagram <> '' THEN '## Diagramme' || chr(10) || chr(10) || '```mermaid' || chr(10) || diagram || chr(10) || '```' || chr(10) END,
'## Composants' || chr(10) || chr(10) || array_to_string(list_transform(classes, lambda x: '- `' || x || '`'), chr(10)) || chr(10),
CASE WHEN len(published) > 0 OR len(subscribed) > 0 THEN '## Flux' || chr(10) || chr(10) || concat_ws(chr(10), CASE WHEN len(published) > 0 THEN '- **Événements publiés** : ' || array_to_string(list_transform(published, lambda x: '`' || x || '`'), ', ') END, CASE WHEN len(subscribed) > 0 THEN '- **Événements consommés** : ' || array_to_string(list_transform(subscribed, lambda x: '`' || x || '`'), ', ') END) || chr(10) END,
'## Sources' || chr(10) || chr(10) || array_to_string(list_transform(sources, lambda x: '- ' || x), chr(10)) || chr(10)) AS page FROM m LEFT JOIN ev USING (module) LEFT JOIN sb USING (module) LEFT JOIN dia USING (module)""")
def module_pages(spark, sf_dir):
    """Modules as Markdown pages with front matter."""
    return modules.base(modules.modules(_classes(spark, sf_dir))).select("module_name", modules.page().alias("page"))


@query(f"""WITH {_CLASSES}, {_MODULES} SELECT 'code:python:' || path AS id_source, '[Code] ' || module AS title, module AS name, len(classes)::INTEGER AS n, array_to_string(classes, ',') AS classes FROM m""")
def module_documents(spark, sf_dir):
    """Modules as normalised documents: what their summaries and metadata say of the classes."""
    rows = modules.documents(modules.modules(_classes(spark, sf_dir)))
    summary = F.from_json(F.regexp_extract("body", r"(?s)```json\n(.*?)\n```", 1), "array<struct<name: string>>")
    meta = F.from_json("meta", "language string, package string, classes array<string>, source_kind string")
    return rows.select("id_source", "title", F.regexp_extract("body", "^# Module : (.*)", 1).alias("name"), F.size(summary).alias("n"), F.when(F.transform(summary, lambda x: x["name"]) == meta["classes"], F.array_join(meta["classes"], ",")).alias("classes"))
