"""Tickets and wiki pages from JSON, and files by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions import text as T

_NAME = "struct<displayName: string>"
ISSUE = (
    "key string, fields struct<summary: string, description: string, status: struct<name: string>, "
    f"assignee: {_NAME}, reporter: {_NAME}, created: string, updated: string, "
    f"comment: struct<comments: array<struct<author: {_NAME}, body: string>>>, "
    "issuelinks: array<struct<type: struct<name: string>, outwardIssue: struct<key: string>, inwardIssue: struct<key: string>>>>, "
    "changelog struct<histories: array<struct<created: string, items: array<struct<field: string, fromString: string, toString: string>>>>>"
)
PAGE = (
    "id string, title string, body struct<storage: struct<value: string>>, version struct<number: int, when: string>, "
    f"history struct<createdBy: {_NAME}, createdDate: string>, space struct<key: string>, "
    "metadata struct<labels: struct<results: array<struct<name: string>>>>"
)
# The reader of each suffix.
READERS = {
    ".docx": "docx", ".xlsx": "xlsx", ".pdf": "pdf", ".txt": "meeting", ".vtt": "meeting", ".md": "obsidian",
    ".drawio": "diagram", ".puml": "diagram", ".plantuml": "diagram", ".mmd": "diagram", ".mermaid": "diagram",
}


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of multi-line JSON files, and the texts of those that don't fit the schema."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_bad")


def _block(title: str, items: Column, between: str) -> Column:
    """A titled block of the items, null without any."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"=== {title} ===\n"), F.array_join(items, between)))


def _said(author: Column, body: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(author, F.lit("?")), F.lit("] "), F.coalesce(body, F.lit("")))


def _body(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts])


def tickets(issues: DataFrame, url: str = "") -> DataFrame:
    """Normalised documents of ISSUE rows; nested arrays are turned into text in place, without a shuffle."""
    f = F.col("fields")
    name = lambda c, other="?": F.coalesce(c, F.lit(other))
    comments = F.coalesce(f["comment"]["comments"], F.array())
    moves = lambda h: F.transform(F.filter(h["items"], lambda i: i["field"] == "status"), lambda i: F.concat(name(h["created"]), F.lit(" : "), name(i["fromString"], "None"), F.lit(" → "), name(i["toString"], "None")))
    changes = F.flatten(F.transform(F.filter(F.coalesce(F.col("changelog.histories"), F.array()), lambda h: F.size(h["items"]) > 0), moves))
    links = F.transform(F.coalesce(f["issuelinks"], F.array()), lambda x: F.concat(name(x["type"]["name"]), F.lit(" : "), F.coalesce(x["outwardIssue"]["key"], x["inwardIssue"]["key"], F.lit("?"))))
    said = F.transform(comments, lambda c: _said(c["author"]["displayName"], c["body"]))
    meta = F.struct(
        F.col("key"), f["status"]["name"].alias("status"), f["assignee"]["displayName"].alias("assignee"),
        F.size(comments).alias("nb_comments"), F.size(changes).alias("nb_status_changes"), F.size(links).alias("nb_links"),
    )
    return issues.select(
        F.col("key").alias("id_source"), F.lit("jira").alias("source_type"), F.concat(F.lit("["), F.col("key"), F.lit("] "), name(f["summary"], "")).alias("title"),
        _body(f["description"], _block("Commentaires", said, "\n\n"), _block("Historique statuts", changes, "\n"), _block("Liens", links, "\n")).alias("body"),
        F.coalesce(f["reporter"]["displayName"], f["assignee"]["displayName"]).alias("author"),
        T.parse_iso(f["created"]).alias("created_at"), T.parse_iso(f["updated"]).alias("modified_at"),
        F.concat(F.lit(f"{url.rstrip('/')}/browse/"), F.col("key")).alias("url"), F.to_json(meta).alias("meta"), F.expr("cast(array() as array<string>)").alias("attachments"),
        F.size(comments).alias("comments"), F.size(changes).alias("status_changes"), F.size(links).alias("links"),
    )


def wiki_pages(pages: DataFrame, comments: DataFrame | None = None, url: str = "", space: str = "") -> DataFrame:
    """Normalised documents of PAGE rows; comments ``id, seq, author, value`` are joined once, not asked for page by page."""
    joined = pages
    said = F.expr("cast(array() as array<string>)")
    if comments is not None:
        author = F.col("author") if "author" in comments.columns else F.lit(None).cast("string")
        each = comments.select(F.col("id"), F.struct("seq", _said(author, T.html_text_exact(F.col("value"))).alias("said")).alias("x"))
        joined = pages.join(each.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs")), "id", "left")  # a page's comments
        said = F.transform(F.coalesce("xs", F.array()), lambda x: x["said"])
    key = F.coalesce(F.col("space.key"), F.lit(space))
    labels = F.transform(F.coalesce(F.col("metadata.labels.results"), F.array()), lambda x: x["name"])
    meta = F.struct(key.alias("space_key"), F.col("version.number").alias("version_number"), F.size(said).alias("nb_comments"), labels.alias("labels"))
    return joined.select(
        F.col("id").alias("id_source"), F.lit("confluence").alias("source_type"), F.coalesce("title", F.lit("(sans titre)")).alias("title"),
        _body(T.html_text_exact(F.coalesce("body.storage.value", F.lit(""))), _block("Commentaires", said, "\n\n")).alias("body"),
        F.col("history.createdBy.displayName").alias("author"), T.parse_iso(F.col("history.createdDate")).alias("created_at"), T.parse_iso(F.col("version.when")).alias("modified_at"),
        F.concat(F.lit(f"{url.rstrip('/')}/wiki/spaces/"), key, F.lit("/pages/"), F.col("id")).alias("url"), F.to_json(meta).alias("meta"),
        F.expr("cast(array() as array<string>)").alias("attachments"), labels.alias("labels"),
    )


def route(files: DataFrame) -> DataFrame:
    """Adds ``reader`` by the path's suffix, any case; null means that no reader takes it."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumn("reader", F.try_element_at(F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv]), suffix))
