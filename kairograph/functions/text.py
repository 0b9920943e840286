"""Column functions on text: all but ``html_text_exact`` are built-in expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_TO_TOKENS = 1.3


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with offset; a fraction only where it isn't zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def parse_iso(value: Column) -> Column:
    """Timestamp of an ISO 8601 text, null if it isn't one."""
    return F.try_to_timestamp(value)


def as_of_date(value: Column) -> Column:
    """Timestamp of an ISO date that a user gives, null without one; a text that is none is an error that names it."""
    bad = F.raise_error(F.concat(F.lit("not an ISO date: "), value)).cast("timestamp")
    return F.when(F.trim(value) == "", None).otherwise(F.coalesce(parse_iso(value), F.when(value.isNotNull(), bad)))


def comma_list(value: Column) -> Column:
    """The items of a list with commas, trimmed, without blank ones; empty for null."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def sheet_name(name: Column, other: str = "Feuille1") -> Column:
    """The name of a sheet: 31 characters at most."""
    cut = F.substring(F.coalesce(name, F.lit("")), 1, 31)
    return F.when(cut == "", other).otherwise(cut)


def parse_pdf_date(value: Column) -> Column:
    """Timestamp of ``D:YYYYMMDD[HHmmSS]``; the zone is ignored, fewer than 8 digits give null."""
    digits = F.regexp_extract(value, r"^(?:D:)?([0-9]{8,14})", 1)
    return F.when(F.length(digits) >= 14, F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss"))).when(
        F.length(digits) >= 8, F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd"))
    )


def episode_key(kind: Column, identifier: Column, body: Column, modified: Column | None = None) -> Column:
    """``type:id:version``; the version is the modification date, or 16 digits of the content's hash."""
    short = F.substring(content_hash(body), 1, 16)
    return F.concat_ws(":", kind, F.translate(identifier, "\\", "/"), short if modified is None else F.coalesce(iso_utc(modified), short))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * F.lit(WORDS_TO_TOKENS))).cast("int")


def html_text(html: Column) -> Column:
    """The text between tags, each piece trimmed, blank ones dropped, a line each; entities stay."""
    parts = F.transform(F.split(html, "<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def strip_tags(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(label, "<[^>]+>", " "), r"\s+", " "))


def file_name(kind: Column, identifier: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.substring(F.regexp_replace(identifier, "[^A-Za-z0-9_.-]", "_"), 1, 80), F.lit(".json"))


def as_link(source: Column) -> Column:
    """A source with a URL as a Markdown link; other sources as they are."""
    url = F.regexp_replace(F.regexp_extract(source, r"https?://\S+", 0), r"[.,;)]+$", "")
    label = F.regexp_replace(F.regexp_extract(source, r"^(?s)(.*?)https?://", 1), r"^[ —:-]+|[ —:-]+$", "")
    linked = F.when(label == "", F.concat(F.lit("<"), url, F.lit(">"))).otherwise(F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")")))
    return F.when(source.rlike(r"https?://\S+"), linked).otherwise(source)


def bullets(items: Column, empty: str = "_Aucun élément identifié._") -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(empty)


def json_block(raw: Column) -> Column:
    """The JSON of a model's answer: inside a fence if there is one, else the text itself."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.trim(raw))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def node_id(prefix: str, name: Column) -> Column:
    safe = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.concat(F.lit(f"{prefix}_"), F.when(safe == "", "x").otherwise(safe))


def first_bytes(content: Column, size: int) -> Column:
    """The first ``size`` bytes of a binary as text, without a character that they cut."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, size).cast("string")), "\ufffd+$", "")


class _Pieces(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []

    def handle_data(self, data: str) -> None:
        if piece := data.strip():
            self.pieces.append(piece)


def _html_pieces(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Pieces()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):
        pass  # what came before a declaration that can't be read stays
    return "\n".join(parser.pieces)


def _html_pieces_of(xs: pd.Series) -> pd.Series:
    return xs.map(_html_pieces)


def html_text_exact(html: Column) -> Column:
    """As ``html_text``, by a parser: entities are decoded, comments and quoted > are seen. It runs in Python, in Arrow batches."""
    return F.pandas_udf(_html_pieces_of, "string")(html)
