"""Documents of source modules: structure as JSON, diagrams, pages, and payloads to complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.text import first_bytes, json_block, node_id
from kairograph.operators import assistant
from kairograph.sources import named

#: What a writer adds to the facts of a module: the payload's fields that are empty at first.
WRITTEN = "description string, composants array<string>, flux array<string>, regles_metier array<string>, risques array<string>"
PAYLOAD = (
    "module_name string, language string, package string, file_path string, classes array<string>, events_published array<string>, events_subscribed array<string>, "
    f"sources array<string>, diagram_mermaid string, {WRITTEN}"
)


def modules(classes: DataFrame) -> DataFrame:
    """``path, module, language, package, classes``: the classes of each file by line."""
    columns = ("line", "class", "line_end", "kind", "methods", "published", "subscribed", "dependencies")
    grouped = classes.groupBy("path", "module", "language", "package").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("classes"))  # one file's classes
    return grouped


def only(found: DataFrame, name: str | None) -> DataFrame:
    """The modules of that name (all without one); ValueError with the names there are if none has it."""
    if name is None:
        return found
    kept = found.where(F.col("module") == name)
    if kept.isEmpty():
        known = [r["module"] for r in found.select("module").distinct().orderBy("module").limit(100).collect()]
        raise ValueError(f"no module {name!r}; known: {', '.join(known)}")
    return kept


def _some(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, xs)


def structure() -> Column:
    """JSON of a module's classes; lists that are empty are left out."""
    each = F.transform("classes", lambda c: F.struct(
        c["class"].alias("name"), c["kind"].alias("kind"), F.concat(c["line"], F.lit("-"), c["line_end"]).alias("lines"), c["methods"].alias("methods"),
        _some(c["published"]).alias("events_published"), _some(c["subscribed"]).alias("events_subscribed"), _some(c["dependencies"]).alias("calls")))
    return F.to_json(each, {"pretty": "true"})


def _context() -> Column:
    return F.concat(F.lit("Module : "), F.col("module"), F.lit("\nLangage : "), F.col("language"), F.lit("\nPackage : "), F.coalesce("package", F.lit("N/A")), F.lit("\n\nÉléments structurels :\n"), structure())


def documents(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Normalised documents of modules; ``files`` (``path, content``) give their first 500 bytes."""
    quoted = F.lit("")
    if files is not None:
        found = found.join(files.select("path", first_bytes(F.col("content"), 500).alias("excerpt")), "path", "left")
        quoted = F.coalesce("excerpt", F.lit(""))
    body = F.concat(
        F.lit("# Module : "), F.col("module"), F.lit("\nLangage : "), F.col("language"), F.lit("\nPackage : "), F.coalesce("package", F.lit("N/A")),
        F.lit("\n\n## Éléments extraits (AST)\n```json\n"), structure(), F.lit("\n```\n\n## Extrait source\n```\n"), quoted, F.lit("\n```"),
    )
    meta = F.struct("language", "package", F.col("classes.class").alias("classes"), F.lit("reverse_engineering").alias("source_kind"))
    return found.select(
        F.concat(F.lit("code:"), "language", F.lit(":"), "path").alias("id_source"), F.lit("obsidian").alias("source_type"), F.concat(F.lit("[Code] "), "module").alias("title"), body.alias("body"),
        F.lit(None).cast("string").alias("author"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"), F.col("path").alias("url"),
        F.to_json(meta).alias("meta"), F.expr("cast(array() as array<string>)").alias("attachments"),
    )


def diagram() -> Column:
    """A module's Mermaid flowchart: classes, events, dependencies once each in order, then edges; the empty text without an edge."""
    quoted = lambda x: F.translate(x, '"', "'")
    box = lambda prefix, name, left, right: F.concat(F.lit("  "), node_id(prefix, name), F.lit(left + '"'), quoted(name), F.lit('"' + right))
    edge = lambda *parts: F.concat(F.lit("  "), *parts)
    event = lambda x: box("e", x, "{{", "}}")
    nodes = F.transform("classes", lambda c: F.concat(
        F.array(box("c", c["class"], "[", "]")), F.transform(c["published"], event), F.transform(c["subscribed"], event), F.transform(c["dependencies"], lambda x: box("d", x, "([", "])"))))
    edges = F.transform("classes", lambda c: F.concat(
        F.transform(c["published"], lambda x: edge(node_id("c", c["class"]), F.lit(" -->|publie| "), node_id("e", x))),
        F.transform(c["subscribed"], lambda x: edge(node_id("e", x), F.lit(" -->|consommé par| "), node_id("c", c["class"]))),
        F.transform(c["dependencies"], lambda x: edge(node_id("c", c["class"]), F.lit(" -.->|appelle| "), node_id("d", x)))))
    lines = F.concat(F.array(F.lit("flowchart LR")), F.array_distinct(F.flatten(nodes)), F.flatten(edges))
    return F.when(F.size(F.flatten(edges)) > 0, F.array_join(lines, "\n")).otherwise("")


def base(found: DataFrame) -> DataFrame:
    """PAYLOAD of modules with what the source alone gives, and ``contexte`` for the writer."""
    all_of = lambda name: F.array_distinct(F.flatten(F.col(f"classes.{name}")))
    sources = F.transform("classes", lambda c: F.concat(F.col("path"), F.lit(":"), c["line"], F.lit("-"), c["line_end"], F.lit(" ("), c["class"], F.lit(")")))
    empty = F.expr("cast(array() as array<string>)")
    return found.select(
        F.col("module").alias("module_name"), "language", "package", F.col("path").alias("file_path"), F.col("classes.class").alias("classes"),
        all_of("published").alias("events_published"), all_of("subscribed").alias("events_subscribed"), sources.alias("sources"), diagram().alias("diagram_mermaid"),
        F.lit("").alias("description"), *[empty.alias(c) for c in ("composants", "flux", "regles_metier", "risques")], _context().alias("contexte"),
    )


def payloads(pages: DataFrame) -> DataFrame:
    """``module_name, value``: the JSON of each base document."""
    return pages.select("module_name", F.to_json(F.struct(*pages.columns)).alias("value"))


def completed(texts: DataFrame, column: str = "value") -> DataFrame:
    """Documents from payloads that a writer has completed; ``contexte`` and unknown keys are left out, bad JSON gives no row."""
    return texts.select(F.from_json(column, PAYLOAD).alias("x")).where(F.col("x.module_name").isNotNull()).select("x.*")


# The keys that a writer fills, as it is told them.
LISTS = ("composants", "flux", "regles_metier", "risques")
SYSTEM = (
    "Tu documentes des modules de code. Décris seulement ce que montrent les éléments structurels donnés. "
    "Réponds en JSON valide avec exactement les clés : description, composants, flux, regles_metier, risques. Ne génère aucun texte en dehors du JSON."
)
SCHEMA = """{
  "description": "description fonctionnelle du module",
  "composants": ["composant 1"],
  "flux": ["flux 1"],
  "regles_metier": ["règle 1"],
  "risques": ["risque 1"]
}"""


def generate(found: DataFrame, client: assistant.Client, kept: str, *, rate: float | None = None, tasks: int = 8) -> DataFrame:
    """Documents of modules whose descriptions a model has written, and ``error``: where the model fails, or says no JSON twice, the document is what the source alone gives.

    A prompt has a module's structure, never its code.
    """
    told = base(found)
    asked = F.concat(F.lit("Voici les éléments structurels du module '"), "module_name", F.lit("' :\n\n"), "contexte", F.lit(f"\n\nGénère la documentation fonctionnelle en JSON selon ce schéma :\n{SCHEMA}"))
    said = assistant.ask(told.withColumn("message", asked), client, kept, rate=rate, tasks=tasks, system=SYSTEM, check=lambda text: assistant.parsed(text, "description", LISTS))
    written = F.when(F.col("error").isNull(), F.from_json(json_block(F.col("raw")), WRITTEN))
    filled = {c: F.coalesce(written[c], F.col(c)) for c in ("description", *LISTS)}
    return said.withColumns(filled).select(*[c for c in told.columns if c != "contexte"], "error")


def page() -> Column:
    """A module's document as Markdown with front matter; sections without content are left out but for the description."""
    coded = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("`"), x, F.lit("`")))
    listed = lambda xs: F.transform(F.coalesce(xs, F.array()), lambda x: F.concat(F.lit("- "), x))
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n"), F.lit("\n")))
    none = F.expr("cast(array() as array<string>)")
    events = lambda title, xs: F.when(F.size(xs) > 0, F.array(F.concat(F.lit(f"- **{title}** : "), F.array_join(coded(xs), ", ")))).otherwise(none)
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("module: "), "module_name"), F.concat(F.lit("language: "), "language"), F.when(F.col("package") != "", F.concat(F.lit("package: "), "package")),
        F.concat(F.lit("tags: [code, "), F.col("language"), F.lit(", reverse-engineering]")), F.lit("---\n"),
    )
    flows = F.concat(listed(F.col("flux")), events("Événements publiés", F.col("events_published")), events("Événements consommés", F.col("events_subscribed")))
    return F.concat_ws(
        "\n", front, F.concat(F.lit("# "), "module_name", F.lit("\n")),
        F.concat(F.lit("## Description fonctionnelle\n\n"), F.when(F.col("description") != "", F.col("description")).otherwise("_Aucune description générée._"), F.lit("\n")),
        F.when(F.col("diagram_mermaid") != "", F.concat(F.lit("## Diagramme\n\n```mermaid\n"), "diagram_mermaid", F.lit("\n```\n"))),
        section("Composants", listed(coded(F.array_distinct(F.concat(F.coalesce("composants", none), F.coalesce("classes", none)))))), section("Flux", flows),
        section("Règles métier détectées", listed(F.col("regles_metier"))), section("Risques / dette technique", listed(F.col("risques"))), section("Sources", listed(coded(F.col("sources")))),
    )


def write_pages(pages: DataFrame, path: str, column: Column | None = None) -> None:
    """A file ``<module>.md`` for each module; of modules of equal name each has its own."""
    text = column if column is not None else page()
    named.write(pages.select(F.concat("module_name", F.lit(".md")).alias("name"), text.alias("value"), F.col("file_path").alias("key")), path)


def write_payloads(pages: DataFrame, path: str) -> None:
    """A file ``<module>.json`` with the payload of each base document."""
    value = F.to_json(F.struct(*pages.columns))
    named.write(pages.select(F.concat("module_name", F.lit(".json")).alias("name"), value.alias("value"), F.col("file_path").alias("key")), path)
