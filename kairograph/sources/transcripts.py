"""Meeting transcripts: plain text, WebVTT, and tables of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The line formats that a transcript may have.
TIMED = r"^\[?([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?)\]?\s+(.*)"
SPEAKER = r"^([A-ZÀÂÄÉÈÊËÎÏÔÙÛÜ][^:\n]{1,60}):\s+(.+)$"
CUE = r"^([0-9]{1,2}:[0-9]{2}:[0-9]{2}\.[0-9]{3})\s+-->\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}"


def _spoken(df: DataFrame, line: str) -> DataFrame:
    speaker = F.regexp_extract(line, SPEAKER, 1)
    return df.withColumns({"speaker": F.when(speaker != "", speaker), "text": F.when(speaker != "", F.regexp_extract(line, SPEAKER, 2)).otherwise(F.col(line))})


def from_text(files: DataFrame) -> DataFrame:
    """``file, seq, ts, speaker, text`` of every non-blank line of ``file, value``."""
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("seq", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    ts = F.regexp_extract("raw", TIMED, 1)
    lines = lines.withColumns({"ts": F.when(ts != "", ts), "rest": F.when(ts != "", F.regexp_extract("raw", TIMED, 2)).otherwise(F.col("raw"))})
    return _spoken(lines, "rest").select("file", "seq", "ts", "speaker", "text")


def from_vtt(files: DataFrame) -> DataFrame:
    """The same of WebVTT. A segment begins at each cue line and ends at the next one or at a blank line; what
    stands before the header or outside of cues goes, and so do notes; a segment's lines are joined by blanks."""
    lines = F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x))
    start = F.array_position(F.transform(lines, lambda x: x.startswith("WEBVTT")), True).cast("int")
    lines = F.when(start > 0, F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = files.select("file", F.posexplode(lines).alias("seq", "line")).where(~F.col("line").startswith("NOTE"))
    own = Window.partitionBy("file").orderBy("seq")  # one file's lines
    cue = F.regexp_extract("line", CUE, 1)
    rows = rows.withColumns({"cue": F.when(cue != "", cue), "blank": F.col("line") == ""})
    rows = rows.withColumn("part", F.sum((F.col("cue").isNotNull() | F.col("blank")).cast("int")).over(own))
    text = F.when(F.col("cue").isNull() & ~F.col("blank"), F.struct("seq", "line"))
    each = rows.groupBy("file", "part").agg(F.min("seq").alias("seq"), F.max("cue").alias("ts"), F.array_sort(F.collect_list(text)).alias("xs"))
    each = each.withColumn("rest", F.array_join(F.transform("xs", lambda x: x["line"]), " ")).where("rest <> '' and ts is not null")
    return _spoken(each, "rest").select("file", "seq", "ts", "speaker", "text")


def assemble(segments: DataFrame, by: str = "file") -> DataFrame:
    """One document per file: its lines in order, sorted distinct speakers and the number of segments."""
    line = F.concat(F.when(F.col("ts").isNotNull(), F.concat(F.lit("["), F.col("ts"), F.lit("] "))).otherwise(""), F.when(F.col("speaker").isNotNull(), F.concat(F.col("speaker"), F.lit(": "))).otherwise(""), F.col("text"))
    grouped = segments.withColumn("line", line).groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("xs"), F.array_sort(F.collect_set("speaker")).alias("participants"), F.count(F.lit(1)).alias("segments"))  # a meeting's lines
    return grouped.select(by, F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("body"), F.array_join("participants", ", ").alias("participants"), "segments")


def with_last_time(lines: DataFrame, by: str, order: str, ts: str) -> DataFrame:
    """Fills each line's time with the last one before it."""
    return lines.withColumn("last_ts", F.last(ts, ignorenulls=True).over(Window.partitionBy(by).orderBy(order)))
