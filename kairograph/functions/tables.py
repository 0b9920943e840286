"""Table functions for SQL: the segments of a transcript, the blocks of a Markdown page, the pages of a drawing.

``register(spark)`` makes ``transcript_segments(text, format)``, ``markdown_blocks(text)`` and ``drawing_pages(xml)``; each gives rows for
one text, and joins laterally with the table that the text is from. Arguments of other types are errors when a query is analysed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from kairograph.sources import binary
from kairograph.sources.transcripts import CUE, SPEAKER, TIMED


def _texts(schema: StructType, *given: AnalyzeArgument) -> AnalyzeResult:
    for i, x in enumerate(given, 1):
        if not isinstance(x.dataType, StringType):
            raise ValueError(f"argument {i} is {x.dataType.simpleString()}, not a text")
    return AnalyzeResult(schema)


def _spoken(text: str) -> tuple[str | None, str]:
    m = re.match(SPEAKER, text)
    return (m[1], m[2]) if m else (None, text)


@udtf
class TranscriptSegments:
    """``seq, ts, speaker, text`` of a transcript, ``text`` (a segment a line) or ``vtt`` (a segment a cue)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, format: AnalyzeArgument) -> AnalyzeResult:
        if format.isConstantExpression and format.value not in ("text", "vtt"):
            raise ValueError(f"format {format.value!r} is neither text nor vtt")
        return _texts(StructType().add("seq", IntegerType()).add("ts", StringType()).add("speaker", StringType()).add("text", StringType()), text, format)

    def eval(self, text: str | None, format: str) -> Iterator[tuple]:
        lines = [x.strip(" ") for x in re.split(r"\r?\n", text or "")]
        if format == "text":
            for seq, line in enumerate(lines):
                if line:
                    timed = re.match(TIMED, line)
                    yield (seq, timed[1] if timed else None, *_spoken(timed[2] if timed else line))
            return
        head = next((i for i, x in enumerate(lines) if x.startswith("WEBVTT")), len(lines))
        seq, ts, said = 0, None, []
        for i, line in [*enumerate(lines[head + 1 :]), (len(lines), "")]:
            cue = re.match(CUE, line)
            if line.startswith("NOTE"):
                continue
            if (cue or not line) and ts is not None:
                if rest := " ".join(said):
                    yield (seq, ts, *_spoken(rest))
                ts, said = None, []
            if cue:
                seq, ts = i, cue[1]
            elif line and ts is not None:
                said.append(line)


@udtf
class MarkdownBlocks:
    """``pos, kind, lines`` of a page: headings, bullets and paragraphs a line each, and tables with all their rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _texts(StructType().add("pos", IntegerType()).add("kind", StringType()).add("lines", ArrayType(StringType())), text)

    def eval(self, text: str | None) -> Iterator[tuple]:
        table: tuple[int, list[str]] | None = None
        for pos, line in [*enumerate((text or "").split("\n")), (-1, "")]:
            if re.search(r"^\s*\|[\s:|-]+\|\s*$", line):
                continue  # a table's separator neither makes a block nor ends one
            bare = line.strip(" ")
            kind = None if not bare or re.search(r"^-{3,}$", bare) else "heading" if re.search(r"^#{1,6}\s+\S", line) else "bullet" if re.search(r"^\s*[-*]\s+\S", line) else "table" if re.search(r"^\s*\|.*\|\s*$", line) else "paragraph"
            if kind == "table":
                table = table or (pos, [])
                table[1].append(line)
                continue
            if table:
                yield table[0], "table", table[1]
                table = None
            if kind:
                yield pos, kind, [line]


@udtf
class DrawingPages:
    """``page, title, body`` of a drawing's XML; none of what can't be read."""

    @staticmethod
    def analyze(xml: AnalyzeArgument) -> AnalyzeResult:
        return _texts(StructType().add("page", IntegerType()).add("title", StringType()).add("body", StringType()), xml)

    def eval(self, xml: str | None) -> Iterator[tuple]:
        for i, (title, body, _) in enumerate(binary.drawio((xml or "").encode())):
            yield i, title, body


def register(spark: SparkSession) -> None:
    for name, table in (("transcript_segments", TranscriptSegments), ("markdown_blocks", MarkdownBlocks), ("drawing_pages", DrawingPages)):
        spark.udtf.register(name, table)
