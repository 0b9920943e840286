"""Answers and documents as Markdown, and Markdown as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions import text as T

ANSWER = "resume string, facts array<string>, decisions array<string>, actions array<string>, risks array<string>, sources array<string>"


def answers(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``answer``, parsed from a model's text; null where the JSON is bad or has no resume."""
    parsed = F.from_json(T.json_block(F.col(column)), ANSWER)
    return raw.withColumn("answer", F.when(parsed["resume"].isNotNull(), parsed))


def answer_markdown(question: Column, answer: Column) -> Column:
    """The answer as a page; sections without items are left out but for the sources."""
    section = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"## {title}\n"), T.bullets(xs)))
    sources = F.coalesce(F.transform(answer["sources"], lambda x: T.as_link(x)), F.array())
    return F.concat_ws(
        "\n\n", F.concat(F.lit("# "), F.regexp_replace(question, r"^\s+|\s+$", "")), F.concat(F.lit("## Résumé\n"), answer["resume"]),
        section("Faits", answer["facts"]), section("Décisions", answer["decisions"]), section("Actions", answer["actions"]), section("Risques", answer["risks"]),
        F.concat(F.lit("## Sources\n"), T.bullets(sources, "_Aucune source._")),
    )


def block_kind(line: Column) -> Column:
    """heading, bullet, table or paragraph; null for blank lines, rules and table separators."""
    return (
        F.when(F.trim(line) == "", None)
        .when(F.trim(line).rlike(r"^-{3,}$"), None)
        .when(line.rlike(r"^\s*\|[\s:|-]+\|\s*$"), None)
        .when(line.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(line.rlike(r"^\s*[-*]\s+\S"), "bullet")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .otherwise("paragraph")
    )


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, kind, line`` of every line that makes a block."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return lines.withColumn("kind", block_kind(F.col("line"))).where(F.col("kind").isNotNull())


def grouped_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, kind, lines``: as ``blocks``, with the rows of a table as one block (gaps and islands over a text's lines)."""
    own = Window.partitionBy(key).orderBy("pos")
    rows = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    ruled = F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$")  # a table's separator neither makes a block nor ends one
    rows = rows.withColumn("kind", block_kind(F.col("line"))).where(~ruled)
    starts = (F.col("kind").isNull() | (F.col("kind") != "table") | ~F.lag("kind").over(own).eqNullSafe("table")).cast("int")
    rows = rows.withColumn("island", F.sum(starts).over(own)).where(F.col("kind").isNotNull())
    found = rows.groupBy(key, "island", "kind").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("xs"))  # one table's rows
    return found.select(key, "pos", "kind", F.transform("xs", lambda x: x["line"]).alias("lines"))


def numbered_sections(blocks_: DataFrame, key: str) -> DataFrame:
    """Adds ``section``: how many headings of the second level stand up to a block."""
    own = Window.partitionBy(key).orderBy("pos")
    return blocks_.withColumn("section", F.sum((F.element_at("lines", 1).rlike(r"^##\s")).cast("int")).over(own))


def cell_text(value: Column, kind: str) -> Column:
    """A cell as text: JSON of arrays, maps and structs, the empty text for null."""
    nested = kind.startswith(("array", "map", "struct"))
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(""))


def table_rows(df: DataFrame, order: str) -> DataFrame:
    """``order, cells``: the rows of a frame as arrays of text, for tabular export; the header is ``df.columns``."""
    return df.select(order, F.array(*[cell_text(F.col(c), t) for c, t in df.dtypes]).alias("cells"))


def union_keys(rows: DataFrame, by: str, column: str) -> DataFrame:
    """The keys of all JSON objects of a group, in the order in which they first appear."""
    keyed = rows.select(by, "ord", F.posexplode(F.json_object_keys(column)).alias("pos", "k"))
    first = keyed.groupBy(by, "k").agg(F.min(F.struct("ord", "pos")).alias("o"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]).alias("header"))
