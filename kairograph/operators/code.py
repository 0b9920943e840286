"""Relations between components of source code, and Mermaid diagrams of them."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.text import node_id

# Verbs in call names that mean publishing, which go first, and subscribing.
PUBLISH = ("publish", "emit", "dispatch", "fire", "raise", "send", "produce")
SUBSCRIBE = ("subscribe", "consume", "listen", "on", "addlistener", "register", "handle")
CONFIDENCE = {"publie": 0.7, "consomme": 0.7, "appelle": 0.5}
CLASSES = (
    "path string, module string, class string, line int, published array<string>, subscribed array<string>, dependencies array<string>, "
    "line_end int, kind string, methods array<string>, language string, package string"
)


def call_kind(name: Column) -> Column:
    """What a called name does, by verbs as parts of it; null if neither."""
    return F.when(F.lower(name).rlike("|".join(PUBLISH)), "publie").when(F.lower(name).rlike("|".join(SUBSCRIBE)), "consomme")


def _kind(name: str) -> str | None:
    low = name.lower()
    return "publie" if any(v in low for v in PUBLISH) else "consomme" if any(v in low for v in SUBSCRIBE) else None


def _events(call: ast.Call) -> list[str]:
    names = [a.func.id if isinstance(a, ast.Call) and isinstance(a.func, ast.Name) else a.id if isinstance(a, ast.Name) else "" for a in call.args]
    return [n for n in names if n.endswith("Event")]


def _classes(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    stem = path.rpartition("/")[2].rpartition(".")[0]
    for c in tree.body:
        if not isinstance(c, ast.ClassDef) or c.decorator_list:
            continue
        found: dict[str, list[str]] = {"publie": [], "consomme": []}
        for f in c.body:
            if isinstance(f, ast.FunctionDef) and not f.decorator_list:
                for call in (n for n in ast.walk(f) if isinstance(n, ast.Call)):
                    name = call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", "")
                    if kind := _kind(name):
                        found[kind] += _events(call)
        fields = [n.annotation.id for n in c.body if isinstance(n, ast.AnnAssign) and isinstance(n.annotation, ast.Name)]
        deps = [n for n in fields if n[:1].isupper() and not n.endswith("Event")]
        methods = [f.name for f in c.body if isinstance(f, ast.FunctionDef) and not f.decorator_list]
        out.append((path, stem, c.name, c.lineno, *(list(dict.fromkeys(x)) for x in (found["publie"], found["consomme"], deps)), c.end_lineno, "class", methods, "python", None))
    return out


# How Java and C# name packages, types, and words that look like calls but are none.
_PACKAGE = {"java": re.compile(r"\bpackage\s+([\w.]+)\s*;"), "csharp": re.compile(r"\bnamespace\s+([\w.]+)")}
_TYPE = {"java": re.compile(r"\b(class|interface|enum)\s+([A-Za-z_]\w*)[^;{]*\{"), "csharp": re.compile(r"\b(class|interface|record)\s+([A-Za-z_]\w*)[^;{]*\{")}
_KEYWORDS = frozenset("if for while switch catch return new throw using lock foreach synchronized sizeof typeof nameof when".split())
_HIDDEN = re.compile(r'//[^\n]*|/\*.*?\*/|@?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_MADE = re.compile(r"\bnew\s+([A-Z]\w*Event)\s*[({]|\btypeof\s*\(\s*(\w+Event)\s*\)|\b([A-Z]\w*Event)\s*\.\s*class\b")
_FIELD = re.compile(r"(?:^|[;{}\]])\s*(?:(?:public|private|protected|internal|static|final|readonly|volatile|transient)\s+)*([A-Z]\w*)(?:<[^;=(){}]*>)?(?:\[\])?\s+\w+\s*(?=[;=,])")
_EVENT_FIELD = re.compile(r"\bevent\s+[\w.<>, ]+?\s+(\w+)\s*[;={]")


def _closing(text: str, at: int, pair: str = "{}") -> int:
    """Place of the bracket that closes the one at ``at``; the text's end if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(text)


def _outside(text: str) -> str:
    """A type's body with the inside of its blocks blanked out."""
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        end = _closing(text, start)
        out += [text[at : start + 1], re.sub(r"[^\n]", " ", text[start + 1 : end])]
        at = end
    return "".join([*out, text[at:]])


def _braced(path: str, source: str, language: str) -> list[tuple]:
    """Outermost types of a language with braces, from its text without comments and strings."""
    text = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    stem = path.rpartition("/")[2].rpartition(".")[0]
    package = _PACKAGE[language].search(text)
    out, at = [], 0
    while m := _TYPE[language].search(text, at):
        start = m.end() - 1
        at = _closing(text, start)
        body = text[start + 1 : at]
        direct = _outside(body)
        methods = [x[1] for x in _CALL.finditer(direct) if x[1] not in _KEYWORDS and re.match(r"[^;{}]*[;{]", direct[_closing(direct, x.end() - 1, "()") + 1 :]) and not re.search(r"(=|\bnew|\.|@)\s*$", direct[: x.start()])]
        found: dict[str, list[str]] = {"publie": [], "consomme": []}
        for call in _CALL.finditer(body):
            if call[1] not in _KEYWORDS and (kind := _kind(call[1])):
                found[kind] += [next(filter(None, e.groups())) for e in _MADE.finditer(body, call.end(), _closing(body, call.end() - 1, "()"))]
        if language == "csharp":
            found["publie"] += _EVENT_FIELD.findall(direct)
        deps = [x for x in _FIELD.findall(re.sub(r"\bevent\b[^;]*;", ";", direct)) if not x.endswith("Event")]
        lines = text.count("\n", 0, m.start()) + 1, text.count("\n", 0, at) + 1
        out.append((path, stem, m[2], lines[0], *(list(dict.fromkeys(x)) for x in (found["publie"], found["consomme"], deps)), lines[1], m[1], methods, language, package[1] if package else None))
    return out


def classes(files: DataFrame) -> DataFrame:
    """CLASSES of source files ``path, content, language`` (python, java or csharp); files that don't parse, or are null, give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CLASSES.split(", ")]
        for batch in batches:
            for path, content, language in zip(batch["path"], batch["content"], batch["language"], strict=True):
                source = "" if content is None else bytes(content).decode(errors="replace")
                yield pd.DataFrame(_classes(path, source) if language == "python" else _braced(path, source, language), columns=names)

    return files.where(F.col("language").isin("python", "java", "csharp")).select("path", "content", "language").mapInPandas(read, CLASSES)


def python_classes(files: DataFrame) -> DataFrame:
    """Top-level undecorated classes of Python files ``path, content`` (binary)."""
    return classes(files.withColumn("language", F.lit("python")))


def relations(classes: DataFrame) -> DataFrame:
    """Candidates of the kinds publie, consomme and appelle."""
    parts = [("published", "publie"), ("subscribed", "consomme"), ("dependencies", "appelle")]
    frames = [
        classes.select(F.col("class").alias("source_component"), F.explode(column).alias("target"), F.lit(kind).alias("kind"), F.col("path").alias("source_file"), "line", F.lit(CONFIDENCE[kind]).alias("confidence"))
        for column, kind in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def event_flow(rel: DataFrame) -> DataFrame:
    """Which component receives what another publishes: an equi-join on the event."""
    sent = rel.where("kind = 'publie'").select(F.col("source_component").alias("publisher"), F.col("target").alias("event"))
    got = rel.where("kind = 'consomme'").select(F.col("source_component").alias("consumer"), F.col("target").alias("event"))
    return sent.join(got, "event").select("publisher", "event", "consumer").distinct()


def mermaid(rel: DataFrame, by: str = "system") -> DataFrame:
    """One flowchart per value of ``by`` (a column): nodes once each in order, then edges; event targets are hexagons."""
    event = F.col("kind").isin("publie", "consomme")
    source, target = node_id("c", F.col("source_component")), F.when(event, node_id("e", F.col("target"))).otherwise(node_id("c", F.col("target")))
    quoted = lambda c: F.translate(c, '"', "'")
    box = lambda i, c: F.concat(F.lit("  "), i, F.lit('["'), quoted(F.col(c)), F.lit('"]'))
    hexagon = F.concat(F.lit("  "), target, F.lit('{{"'), quoted(F.col("target")), F.lit('"}}'))
    arrow = F.when(F.col("kind") == "appelle", "-.->").otherwise("-->")
    edge = F.concat(F.lit("  "), source, F.lit(" "), arrow, F.lit("|"), F.col("kind"), F.lit("| "), target)
    rows = rel.select(F.col(by), F.struct("source_file", "line", "kind", "target").alias("o"), F.array(box(source, "source_component"), F.when(event, hexagon).otherwise(box(target, "target"))).alias("n"), edge.alias("e"))
    grouped = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("o", "n", "e"))).alias("xs"))  # one system's relations
    lines = F.concat(F.array(F.lit("flowchart LR")), F.array_distinct(F.flatten(F.col("xs.n"))), F.col("xs.e"))
    return grouped.select(by, F.array_join(lines, "\n").alias("diagram"))
