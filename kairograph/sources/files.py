"""Text files as documents, scans of source code, and the sources by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions import text as T
from kairograph.sources import binary, git, paged, records, transcripts

# Suffixes of source code by language, folders that a scan leaves out, and formats of text diagrams by suffix.
LANGUAGES = {".java": "java", ".py": "python", ".cs": "csharp"}
SKIPPED = (".git", "__pycache__", ".venv", "node_modules", "target", "build")
DIAGRAMS = {".puml": "plantuml", ".plantuml": "plantuml", ".mmd": "mermaid", ".mermaid": "mermaid"}

_COLUMNS = ("id_source", "source_type", "title", "body", "author", "created_at", "modified_at", "url", "meta", "attachments")
_SUFFIX = r"(\.[^./\\]+)$"


def _by_suffix(table: dict[str, str]):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.regexp_extract("path", _SUFFIX, 1)))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value, size, modified_at`` of whole files; blank files too."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified_at"))


def text_diagrams(files: DataFrame) -> DataFrame:
    """Normalised documents of PlantUML and Mermaid files ``path, value, size, modified_at``, as they are; blank ones have none."""
    rows = files.withColumn("format", _by_suffix(DIAGRAMS)).where(F.col("format").isNotNull() & (F.trim("value") != ""))
    clean = F.regexp_replace("path", "^file:(//)?", "")
    return rows.select(
        clean.alias("id_source"), F.lit("diagram").alias("source_type"), F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "").alias("title"),
        F.col("value").alias("body"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("created_at"), "modified_at", F.col("path").alias("url"),
        F.to_json(F.struct("format", F.col("size").alias("taille_octets"))).alias("meta"), F.expr("cast(array() as array<string>)").alias("attachments"),
    )


def source_code(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, language`` of the source files below a folder, without those in SKIPPED folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    inside = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return rows.withColumn("language", _by_suffix(LANGUAGES)).where(F.col("language").isNotNull() & ~F.col("path").rlike(f"/({inside})/"))


def meetings(spark: SparkSession, path: str) -> DataFrame:
    """Normalised documents of transcripts in plain text and WebVTT."""
    return transcript_documents(text_files(spark, path))


def transcript_documents(texts: DataFrame) -> DataFrame:
    """The same of files ``path, value, size``."""
    files = texts.withColumn("file", F.col("path"))
    vtt = F.lower("path").endswith(".vtt")
    segments = transcripts.from_text(files.where(F.lower("path").endswith(".txt"))).unionByName(transcripts.from_vtt(files.where(vtt)))
    whole = transcripts.assemble(segments).join(files.select("file", "size"), "file")
    clean = F.regexp_replace("file", "^file:(//)?", "")
    meta = F.struct(F.lower(F.regexp_extract("file", r"([^.]*)$", 1)).alias("format"), F.col("segments").alias("nb_segments"), F.split("participants", ", ").alias("participants"), F.col("size").alias("taille_octets"))
    return whole.select(
        clean.alias("id_source"), F.lit("meeting").alias("source_type"), F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "").alias("title"), "body",
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"), F.col("file").alias("url"),
        F.to_json(meta).alias("meta"), F.expr("cast(array() as array<string>)").alias("attachments"),
    )


def _parts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return binary.parts(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(path), kind)


def _office(kind: str):
    return lambda spark, path: binary.documents(_parts(spark, path, kind), kind)


def _wiki(spark: SparkSession, url: str, space: str) -> DataFrame:
    """Pages with their comments."""
    rows = paged.pages(spark, url, space)
    return records.wiki_pages(rows, paged.comments(rows, url), url=url, space=space)


def folder(spark: SparkSession, path: str, pdf=None) -> tuple[DataFrame, DataFrame]:
    """Normalised documents of the files right in a folder, each by the reader of its suffix, and ``path, reason`` of the files that gave none.

    A file is unreadable, of a suffix without a reader, or (PDF) in need of one, which ``pdf`` gives (``binary.pdf``). Documents
    carry ``path``; ordered by it they are in the order of names.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    routed = records.route(listed)
    routed = routed.withColumn("reader", F.when(F.lower("path").endswith(".drawio.xml"), "diagram").otherwise(F.col("reader")))
    suffix = F.lower(F.regexp_extract("path", _SUFFIX, 1))
    drawn = (F.col("reader") == "diagram") & suffix.isin(".drawio", ".xml")
    taken, reasons = [], []
    kinds = [("docx", F.col("reader") == "docx", None), ("xlsx", F.col("reader") == "xlsx", None), ("drawio", drawn, None)] + ([("pdf", F.col("reader") == "pdf", pdf)] if pdf else [])
    for kind, own, read in kinds:
        found = binary.parts(routed.where(own), kind, read) if read else binary.parts(routed.where(own), kind)
        taken.append(binary.documents(found, kind).withColumn("path", F.col("url")))
        reasons.append(binary.broken(found).select("path", F.col("error").alias("reason")))
    said = routed.withColumn("value", F.decode("content", "UTF-8"))
    taken.append(text_diagrams(said.where(F.col("reader").eqNullSafe("diagram") & ~drawn)).withColumn("path", F.col("url")))
    taken.append(notes(said.where(F.col("reader").eqNullSafe("obsidian"))).withColumn("path", F.col("url")))
    taken.append(transcript_documents(said.where(F.col("reader").eqNullSafe("meeting"))).withColumn("path", F.col("url")))
    lost = F.col("reader").isNull() | ((F.col("reader") == "pdf") & F.lit(pdf is None))
    reasons.append(routed.where(lost).select("path", F.when(F.col("reader").isNull(), "no reader of this suffix").otherwise("no reader of PDF given").alias("reason")))
    columns = [*_COLUMNS, "path"]
    documents, broken = taken[0].select(*columns), reasons[0]
    for x in taken[1:]:
        documents = documents.unionByName(x.select(*columns))
    for x in reasons[1:]:
        broken = broken.unionByName(x)
    return documents, broken


def notes(files_: DataFrame) -> DataFrame:
    """Normalised documents of Markdown notes ``path, value, size, modified_at``; blank ones have none."""
    rows = files_.where(F.trim("value") != "")
    return rows.select(
        F.regexp_replace("path", "^file:(//)?", "").alias("id_source"), F.lit("obsidian").alias("source_type"), F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "").alias("title"),
        F.col("value").alias("body"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("created_at"), "modified_at", F.col("path").alias("url"),
        F.to_json(F.struct(F.col("size").alias("taille_octets"))).alias("meta"), F.expr("cast(array() as array<string>)").alias("attachments"),
    )


def _commits(spark: SparkSession, path: str) -> DataFrame:
    git.register(spark)
    log = git.commit_documents(spark.read.format("gitlog").load(path), path)
    return log.unionByName(git.ref_documents(spark.read.format("gitrefs").load(path), path))


#: Each source by its name: the arguments that it needs, and its reader.
SOURCES = {
    "jira": (("url", "query"), lambda spark, url, query: records.tickets(paged.tickets(spark, url, query), url)),
    "confluence": (("url", "space"), _wiki),
    "git": (("path",), _commits),
    "meeting": (("path",), meetings),
    "diagram": (("path",), lambda spark, path: _office("drawio")(spark, path).unionByName(text_diagrams(text_files(spark, path)))),
    "docx": (("path",), _office("docx")),
    "xlsx": (("path",), _office("xlsx")),
    "folder": (("path",), lambda spark, path: folder(spark, path)[0]),
}


def quarantined(spark: SparkSession, source: str, path: str) -> DataFrame:
    """``path, reason`` of the files below a path that the source could not read (of a folder: that gave no document)."""
    if source == "folder":
        return folder(spark, path)[1]
    kind = {"diagram": "drawio"}.get(source, source)
    return binary.broken(_parts(spark, path, kind)).select("path", F.col("error").alias("reason"))


def read(spark: SparkSession, source: str, **given: str) -> DataFrame:
    """Normalised documents of a source; ValueError for an unknown source, or an argument that is missing or not known."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sorted(SOURCES))}")
    needs, reader = SOURCES[source]
    missing, more = [n for n in needs if not given.get(n)], sorted(set(given) - set(needs))
    if missing or more:
        raise ValueError(f"source {source!r} needs {', '.join(needs)}; missing: {missing}; unknown: {more}")
    return reader(spark, **given)


def excerpt(content, size: int = 500):
    """The first bytes of a file as text, as documents of source code quote them."""
    return T.first_bytes(content, size)
