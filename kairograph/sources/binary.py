"""Office files and drawings from their bytes, with the standard library inside tasks."""

from __future__ import annotations

import base64
import io
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions import text as T

PARTS = "path string, part int, title string, body string, meta map<string, string>"
#: What a damaged, encrypted or odd file may raise; such a file goes to quarantine instead of ending the job.
_BROKEN = (KeyError, ValueError, IndexError, AttributeError, TypeError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, ET.ParseError)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _table(rows: list[list[str]]) -> str:
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *lines[1:]]) if lines else ""


def docx(data: bytes) -> list[tuple[str, str, dict]]:
    """Paragraphs (headings as #), then all tables; bars in cells escaped."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    if body is None:
        return []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for p in body.findall(f"{_W}p"):
        if said := text(p).strip():
            style = p.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"Heading\s*(\d)", style.get(f"{_W}val") if style is not None else "")
            out.append("#" * int(m[1]) + " " + said if m else said)
    for t in body.findall(f"{_W}tbl"):
        out.append(_table([[text(c).strip().replace("|", "\\|") for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]))
    return [("", "\n\n".join(out), {"nb_paragraphes": len(body.findall(f"{_W}p")), "nb_tableaux": len(body.findall(f"{_W}tbl"))})]


def xlsx(data: bytes) -> list[tuple[str, str, dict]]:
    """A table per sheet that has cells; bars in cells stay."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        rows = []
        for r in ET.fromstring(z.read("xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/"))).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for at, c in enumerate(r.findall(f"{_S}c")):
                v, ref = c.find(f"{_S}v"), re.match("[A-Z]+", c.get("r") or "")
                col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) - 1 if ref else at
                cells[col] = shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        if any(any(r) for r in rows):
            width = max(map(len, rows))
            name = sheet.get("name")
            table = _table([r + [""] * (width - len(r)) for r in rows])
            out.append((name, f"## Feuille : {name}\n\n{table}", {"sheet_name": name, "nb_lignes": len(rows), "nb_colonnes": width}))
    return out


def _model(page: ET.Element) -> ET.Element | None:
    """The page's graph: its child, or base64 of raw deflate of percent-coded XML."""
    if (child := page.find("mxGraphModel")) is not None:
        return child
    try:
        return ET.fromstring(urllib.parse.unquote(zlib.decompress(base64.b64decode(page.text or ""), -15).decode()))
    except (ValueError, zlib.error, ET.ParseError):
        return None


def drawio(data: bytes) -> list[tuple[str, str, dict]]:
    """A document per page: elements, then connections; bad XML gives none.

    A cell is named by its label (that of a wrapping object goes first), else by its id; so is an end that no cell has.
    """
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return []
    pages = [root] if root.tag == "diagram" else root.findall("diagram")
    models = [(p.get("name") or f"page{i}", _model(p)) for i, p in enumerate(pages, 1)] or [("page1", root)] * (root.tag == "mxGraphModel")
    plain = lambda x: re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", x or "")).strip()
    out = []
    for name, model in models:
        if model is None:
            continue
        wraps = {id(c): o.get("label") or o.get("value") for o in model.iter("object") for c in o.findall("mxCell")}
        cells = {c.get("id"): (c, wraps.get(id(c)) or c.get("value")) for c in model.iter("mxCell")}
        said = lambda key, cells=cells: (plain(cells[key][1]) or key) if key in cells else key
        nodes = [said(key) for key, (c, _) in cells.items() if c.get("vertex") == "1"]
        arrows = []
        for c, value in cells.values():
            if c.get("vertex") != "1" and c.get("edge") == "1" and c.get("source") and c.get("target"):
                ends = said(c.get("source")), said(c.get("target"))
                label = said(c.get("id")) if value else ""
                arrows.append(f"{ends[0]} --{label}--> {ends[1]}" if label and label not in ends else f"{ends[0]} --> {ends[1]}")
        lines = [f"# Diagramme drawio : {name}", ""]
        lines += ["## Éléments", *(f"- {n}" for n in dict.fromkeys(nodes)), ""] if nodes else []
        lines += ["## Connexions", *(f"- {x}" for x in dict.fromkeys(arrows))] if arrows else []
        out.append((name, "\n".join(lines), {"format": "drawio", "page": name}))
    return out


def pdf(pages: Callable[[bytes], tuple[list[str], dict]]) -> Callable[[bytes], list[tuple[str, str, dict]]]:
    """A reader of PDF files around ``pages``, which gives the text of each page and the file's properties; no PDF library is assumed here."""

    def read(data: bytes) -> list[tuple[str, str, dict]]:
        texts, about = pages(data)
        keep = {k: about[k] for k in ("author", "creationDate", "modDate", "title", "subject") if about.get(k)}
        return [(f"page {i}", f"[Page {i}]\n{t}", {"page": i, "total_pages": len(texts), **keep}) for i, t in enumerate(texts, 1) if t.strip()]

    return read


READ = {"docx": docx, "xlsx": xlsx, "drawio": drawio}


def parts(files: DataFrame, kind: str, read: Callable[[bytes], list[tuple[str, str, dict]]] | None = None) -> DataFrame:
    """``path, part, title, body, meta`` of ``path, content`` (as ``binaryFile`` reads them).

    A file that can't be read, or has no content, gives one row with part -1 and the error in ``meta``: see ``documents`` and ``broken``.
    """
    read = read or READ[kind]
    names = [c.split()[0] for c in PARTS.split(", ", 4)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = read(bytes(content))
                    size = {"taille_octets": str(len(content))}
                    rows = [(path, i, t, b, {k: str(v) for k, v in m.items()} | size) for i, (t, b, m) in enumerate(found)]
                except _BROKEN as e:
                    rows = [(path, -1, None, None, {"error": f"{type(e).__name__}: {e}"[:500]})]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(each, PARTS)


def broken(found: DataFrame) -> DataFrame:
    """``path, error`` of the files in quarantine."""
    return found.where("part < 0").select("path", F.col("meta")["error"].alias("error"))


# What parts of a file are called, by kind, in identifiers and in titles.
_PART = {"xlsx": ("#", " — "), "pdf": ("#", " — "), "drawio": ("#", " — ")}


def documents(found: DataFrame, kind: str) -> DataFrame:
    """Normalised documents of ``parts``: one for each sheet, page or diagram, else for each file."""
    path = F.translate(F.regexp_replace("path", "^file:(//)?", ""), "\\", "/")
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    mark, dash = _PART.get(kind, ("", ""))
    of = F.translate("title", " ", "") if kind == "pdf" else F.col("title")
    return found.where("part >= 0").select(
        (F.concat(path, F.lit(mark), of) if mark else path).alias("id_source"), F.lit("diagram" if kind == "drawio" else kind).alias("source_type"),
        (F.concat(stem, F.lit(dash), F.col("title")) if mark else stem).alias("title"), "body", F.try_element_at("meta", F.lit("author")).alias("author"),
        T.parse_pdf_date(F.try_element_at("meta", F.lit("creationDate"))).alias("created_at"), T.parse_pdf_date(F.try_element_at("meta", F.lit("modDate"))).alias("modified_at"),
        F.col("path").alias("url"), F.to_json("meta").alias("meta"), F.expr("cast(array() as array<string>)").alias("attachments"),
    )
