"""Removal of line chunks that repeat anywhere in the corpus.

A line ends at a newline or after a sentence's end, so that passages inside a
paragraph are seen too; longer ones, also those that are a whole text, are split
after words (where there are no blanks, between signs) chosen by a hash. A
rolling hash over the hashes of neighbouring lines chooses the boundaries. A
boundary depends on the lines beside it only, and so a passage is cut alike
wherever it stands. A chunk begins at each boundary and goes on to the first
that makes it several lines: chunks overlap, since a passage of fifty words
has few lines and must hold a whole one. Chunks that occur more than once are
compared, byte by byte, with the first occurrence in the corpus; equal ones go,
with the words beside them as far as these equal the words beside the first
occurrence as well.

Lines, hashes and chunks of a block of texts come from a few numpy passes, so
that chunking anew is cheaper than keeping chunks. What moves is a row per text
and distinct chunk hash, to find first occurrences, and the bytes of a first
occurrence once and of the repeats that cover the others once. Texts move
only where tables that answer for them outgrow a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged, text_bytes

#: Every line's end is a boundary but for one of so many, by the rolling hash.
SPARE = 16
LEAST, MOST = 2, 32  # lines in a chunk, and between boundaries
#: Chunks have this many bytes at least: fewer are no passage.
LEAST_BYTES = 64
#: Lines of more bytes are split after one word of so many, chosen by a hash of the 8 bytes before its end.
LONG, WORDS = 100, 8
#: What the hash leaves whole, such as one word said over and over, is split after the first word beyond so many bytes.
FORCED = 256
#: What has no blank (nor kana or Han sign) for more than FORCED bytes is split between signs, after one byte of so many.
SIGNS = 64
#: Bytes beside a chunk that are compared too.
BESIDE = 128
#: First occurrences (16 bytes each, 64 MB in all) up to which they are broadcast; beyond that the chunks are joined with them.
BROADCAST_FIRSTS = 4_000_000
#: Texts with spans to remove (some 60 bytes each) up to which these are broadcast; beyond that all texts are shuffled once.
BROADCAST_ROWS = 300_000
#: Bytes that are chunked at once; longer texts are gone through in parts.
BLOCK = 1 << 18

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WHITE = b"\t\n\v\f\r "
_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _A
    return x ^ x >> np.uint64(29)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, and the powers of an odd base and of its inverse modulo 2^64."""
    if n not in _POWERS:
        _POWERS.clear()
        base = 0xD6E8FEB86659FD93
        tables = [np.full(n, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for table in tables:
            table[0] = 1
        _POWERS[n] = (np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64), *(np.cumprod(x, dtype=np.uint64) for x in tables))
    return _POWERS[n]


def _line_ends(d: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lines of texts that begin at ``begins``, of ``d`` in all, after and before long ones are split; blanks beside a line may belong to either side."""
    blank, stop = (d == 0x0A) | (d == 0x20), (d == 0x2E) | (d == 0x21) | (d == 0x3F)
    end = np.append(d == 0x0A, True)  # before these bytes
    end[1:-1] |= stop[:-1] & blank[1:]
    end[begins] = True
    if (d >= 0xE3).any():  # full-width signs
        e3, ef = np.flatnonzero(d[:-2] == 0xE3), np.flatnonzero(d[:-2] == 0xEF)
        signs = np.concatenate([e3[(d[e3 + 1] == 0x80) & (d[e3 + 2] == 0x82)], ef[(d[ef + 1] == 0xBC) & ((d[ef + 2] == 0x81) | (d[ef + 2] == 0x9F))]])
        end[np.setdiff1d(signs + 3, signs)] = True
    ends = natural = np.flatnonzero(end)
    wide = np.diff(ends) > LONG
    if wide.any():
        han = (d >= 0xE3) & (d <= 0xE9)  # first bytes of kana and Han signs, which no blanks part
        words = np.flatnonzero(han | (d == 0x20))
        every = None
        if (np.diff(words, prepend=-1, append=len(d)) > FORCED).any():  # other scripts without blanks, encoded bytes
            every, stops = np.full(len(d), WORDS, dtype=np.uint32), np.union1d(words, ends)
            for i in np.flatnonzero(np.diff(stops) > FORCED).tolist():
                start, stop = int(stops[i]) + 1, int(stops[i + 1])
                han[start:stop] |= (d[start:stop] & 0xC0) != 0x80
                every[start:stop] = SIGNS
            words = np.flatnonzero(han | (d == 0x20))
        line = np.searchsorted(ends, words, side="right") - 1
        at = words[wide[line] & (words - ends[line] >= 8)]
        h = np.zeros(len(at), dtype=np.uint32)
        for k in range(8, 0, -1):
            h = (h ^ d[at - k]) * np.uint32(2654435761)
        at = at[(h >> 24) % (WORDS if every is None else every[at]) == 0]
        end[at + ~han[at]] = True  # after the blank
        ends = np.flatnonzero(end)
        for i in np.flatnonzero(np.diff(ends) > FORCED).tolist():
            start, stop = int(ends[i]), int(ends[i + 1])
            while stop - start > FORCED and (k := np.searchsorted(words, start + FORCED)) < len(words) and words[k] + 1 < stop:
                start = int(words[k]) + int(not han[words[k]])
                end[start] = True
        ends = np.flatnonzero(end)
    return ends, natural


def _chunked(d: np.ndarray, begins: np.ndarray, opens: bool = True, closes: bool = True, number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int]:
    """Hash, start and end of each chunk of a block of texts, by start.

    If the block doesn't open at a text's start, its first line is line ``number`` of its text; if it doesn't close at a
    text's end, its last line has no end yet. The last results are where a further block has to begin, the number of
    the line there, and where the first chunk starts that this block leaves to it.
    """
    ends, natural = _line_ends(d, begins)
    white = np.zeros(256, dtype=bool)
    white[list(_WHITE)] = True
    solid = ~white[d]
    before = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])  # bytes but blanks before each place
    places = np.flatnonzero(solid)
    some = before[ends[1:]] > before[ends[:-1]]
    low, high = ends[:-1][some], ends[1:][some]
    starts, stops = places[before[low]], places[before[high] - 1] + 1
    if not closes:
        starts, stops = starts[:-1], stops[:-1]
    n = len(starts)
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return none, none, none, 0, number, 0
    values, power, inverse = _powers(BLOCK + 1 if len(d) <= BLOCK else len(d))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[d] * power[: len(d)], dtype=np.uint64)])
    hashed = lambda a, b: _mixed((sums[b] - sums[a]) * inverse[a])
    # slots stand for places between lines; a text of n lines has n + 1 of them, and texts share none
    text = np.searchsorted(begins, starts, side="right") - 1
    first = np.searchsorted(text, np.arange(len(begins)))
    count = np.diff(np.append(first, n))
    opening = first + np.arange(len(begins))
    owner = np.repeat(np.arange(len(begins)), count + 1)
    line = np.arange(n + len(begins)) - owner  # after the slot
    place = line - first[owner]  # of the slot in its text
    h = hashed(starts, stops)
    rolling = np.zeros(n + 1, dtype=np.uint64)
    rolling[1:n] = h[1:] * _A + h[:-1] * _B >> np.uint64(33)
    chosen = (rolling[line] % np.uint64(SPARE) != 0) | ((place + number) % MOST == 0)
    chosen[opening + count] = closes
    chosen[opening] = opens
    slots = np.flatnonzero(chosen)
    if not len(slots):
        return none, none, none, 0, number, 0
    reach = np.where(place[slots] > 0, stops[line[slots] - 1], begins[owner[slots]])  # bytes up to each slot
    begin = slots[place[slots] < count[owner[slots]]]
    head = starts[line[begin]]
    to = np.maximum(np.searchsorted(slots, begin + LEAST), np.searchsorted(reach, head + LEAST_BYTES))
    whole = to < len(slots)
    whole[whole] = owner[slots[to[whole]]] == owner[begin[whole]]
    last = stops[line[slots[to[whole]]] - 1]
    left = int(line[begin[~whole][0]]) if not whole.all() else n - 1
    go = int(natural[np.searchsorted(natural, starts[max(0, left - 1)], side="right") - 1])  # with a line of context
    return hashed(head[whole], last).view(np.int64), head[whole], last, go, number + int(np.searchsorted(starts, go)), int(starts[left])


def chunk_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each chunk of a text, by start; a line longer than BLOCK ends there."""
    if len(data) <= BLOCK:
        return _chunked(np.frombuffer(data, dtype=np.uint8), np.zeros(1, dtype=np.int64))[:3] if data else (np.zeros(0, dtype=np.int64),) * 3
    out, at, number, opens, least = [], 0, 0, True, 0
    while True:
        part = np.frombuffer(data, dtype=np.uint8, count=min(BLOCK, len(data) - at), offset=at)
        final = at + len(part) == len(data)
        h, a, b, go, then, left = _chunked(part, np.zeros(1, dtype=np.int64), opens, final, number)
        if force := not final and not go:
            h, a, b, *_ = _chunked(part, np.zeros(1, dtype=np.int64), opens, True, number)
            go, then, left = len(part), 0, len(part)
        new = a + at >= least
        out.append((h[new], a[new] + at, b[new] + at))
        if final:
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))
        at, number, opens, least = at + go, then, force, at + left


def chunk_texts(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts: number of the first one, their bytes joined, where each begins, and chunks: text (within the group), hash, start, end."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= BLOCK:
            size += len(texts[to])
            to += 1
        data = b"".join(texts[at:to])
        begins = np.cumsum([0, *map(len, texts[at : to - 1])])
        if to == at + 1:
            h, a, b = chunk_arrays(data)
        elif data:
            filled = np.flatnonzero(np.diff(np.append(begins, len(data))))
            h, a, b = _chunked(np.frombuffer(data, dtype=np.uint8), begins[filled])[:3]
        else:
            h = a = b = np.zeros(0, dtype=np.int64)
        yield at, data, begins, np.searchsorted(begins, a, side="right") - 1, h, a, b
        at = to


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``chunk_texts`` of a batch's ``data``, a few rows at a time, so that its texts aren't held twice; numbers count from the batch's start."""
    for at in range(0, batch.num_rows, 128):
        for first, *rest in chunk_texts(batch.column("data").slice(at, 128).to_pylist()):
            yield at + first, *rest


def chunks(data: bytes) -> list[tuple[int, int, int]]:
    """``(hash, start, end)`` of each chunk."""
    return list(zip(*(x.tolist() for x in chunk_arrays(data)), strict=True))


def _common_left(x: bytes, y: bytes) -> int:
    """Length of the longest common end that begins at a word of both, or at the start of both."""
    n = min(len(x), len(y))
    k = next((i for i in range(n) if x[-1 - i] != y[-1 - i]), n)
    if k == len(x) == len(y):
        return k
    while k and not (x[len(x) - k - 1 : len(x) - k] in (b"\t", b"\n", b"\v", b"\f", b"\r", b" ") or 0xE3 <= x[len(x) - k] <= 0xE9):
        k -= 1
    return k


def _common_right(x: bytes, y: bytes) -> int:
    """Length of the longest common start that ends at a word of both, or at the end of both."""
    n = min(len(x), len(y))
    k = next((i for i in range(n) if x[i] != y[i]), n)
    if k == len(x) == len(y):
        return k
    while k and not (x[k - 1] in _WHITE or k > 2 and 0xE3 <= x[k - 3] <= 0xE9):  # after a blank or sign
        k -= 1
    return k


_HASHES = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("i", pa.int32()), ("rid", pa.int64())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct chunk hashes of each text, how often they occur in it, and the number of the first such chunk."""
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        for at, _, begins, text, h, _, _ in _grouped(batch):
            if len(h):
                order = np.lexsort((h, text))
                new = np.flatnonzero(np.append(True, (np.diff(h[order]) != 0) | (np.diff(text[order]) != 0)))
                one = order[new]  # lexsort is stable
                n = np.diff(np.append(new, len(h)))
                i = one - np.searchsorted(text, np.arange(len(begins)))[text[one]]
                yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array(n.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(rid[at + text[one]])], schema=_HASHES)


_FOUND = pa.schema([("h", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("lead", pa.bool_()), ("edge", pa.bool_()), ("body", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])
_FOUND_DDL = "h long, rid long, start int, lead boolean, edge boolean, body binary, before binary, after binary"


def _needed(text: list[int], starts: list[int], ends: list[int]) -> list[tuple[int, bool]]:
    """Numbers of the repeats without those that the ones before and after them cover, and whether each begins
    or ends a run of repeats, so that the words beside it matter."""
    out, covered, seen, at = [], -2, -2, -1  # covered by those named, by all
    for i, (t, a, b) in enumerate(zip(text, starts, ends, strict=True)):
        if t != at:
            covered = seen = -2
            at = t
        more = i + 1 < len(starts) and text[i + 1] == t
        following = starts[i + 1] if more else 1 << 62
        if following > covered + 1:
            out.append((i, a > seen + 1 or following > b + 1))
            covered = b
        seen = b
    return out


def _pieces(data: bytes, begins: np.ndarray, text: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, rid: np.ndarray, first: np.ndarray, known: np.ndarray) -> pa.RecordBatch | None:
    """Rows of the first occurrences and of the repeats that are needed, with their bytes and those beside them.

    ``first`` has the text with the first occurrence of each chunk where ``known``.
    """
    own = known & (first == rid[text])
    lead = np.zeros(len(h), dtype=bool)
    at = np.flatnonzero(own)
    if len(at):
        order = at[np.lexsort((h[at], text[at]))]
        lead[order[np.append(True, (np.diff(h[order]) != 0) | (np.diff(text[order]) != 0))]] = True
    repeats = np.flatnonzero(known & ~lead)
    named = _needed(text[repeats].tolist(), a[repeats].tolist(), b[repeats].tolist())
    use = np.concatenate([np.flatnonzero(lead), repeats[[i for i, _ in named]]]) if named else np.flatnonzero(lead)
    if not len(use):
        return None
    leads = int(lead.sum())
    edge = np.append(np.ones(leads, dtype=bool), np.array([e for _, e in named], dtype=bool))
    stop = np.append(begins[1:], len(data))[text]  # ends of the texts
    left, right = np.maximum(begins[text], a - BESIDE), np.minimum(stop, b + BESIDE)
    # no further than the chunks before and after begin and end: beyond that equal bytes would have made a chunk
    left[1:] = np.where(text[1:] == text[:-1], np.maximum(left[1:], a[:-1]), left[1:])
    then = np.searchsorted(b, b, side="right")
    inside = then < len(b)
    inside[inside] = text[then[inside]] == text[inside]
    right[inside] = np.minimum(right[inside], b[then[inside]])
    cut = lambda low, high: pa.array([data[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
    a_, b_, e = a[use], b[use], edge
    return pa.RecordBatch.from_arrays(
        [pa.array(h[use]), pa.array(rid[text[use]]), pa.array((a_ - begins[text[use]]).astype(np.int32)), pa.array(np.arange(len(use)) < leads), pa.array(e),
         cut(a_, b_), cut(np.where(e, left[use], a_), a_), cut(b_, np.where(e, right[use], b_))], schema=_FOUND)


def _by_table(shared):
    """The pass over texts (``rid, data``) that looks chunks up in the broadcast first occurrences."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, firsts = shared.value
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for at, data, begins, text, h, a, b in _grouped(batch):
                where = np.searchsorted(hashes, h).clip(max=max(0, len(hashes) - 1))
                known = hashes[where] == h if len(hashes) else np.zeros(len(h), dtype=bool)
                out = _pieces(data, begins, text, h, a, b, rid[at : at + len(begins)], firsts[where] if len(hashes) else h, known)
                if out is not None:
                    yield out

    return find


def _by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same where each text brings its own ``hashes`` and ``firsts``."""
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        for i in range(batch.num_rows):
            hashes, firsts = (batch.column(c)[i].values.to_numpy() for c in ("hashes", "firsts"))
            order = np.argsort(hashes, kind="stable")
            hashes, firsts = hashes[order], firsts[order]
            data = batch.column("data")[i].as_py()
            h, a, b = chunk_arrays(data)
            where = np.searchsorted(hashes, h).clip(max=len(hashes) - 1)
            out = _pieces(data, np.zeros(1, dtype=np.int64), np.zeros(len(h), dtype=np.int64), h, a, b, rid[i : i + 1], firsts[where], hashes[where] == h)
            if out is not None:
                yield out


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        left = [_common_left(x, y) if x and y else 0 for x, y in zip(part["before"], part["r_before"], strict=True)]
        right = [_common_right(x, y) if x and y else 0 for x, y in zip(part["after"], part["r_after"], strict=True)]
        start = part["start"].to_numpy(dtype=np.int64)
        yield pd.DataFrame({"rid": part["rid"], "start": start - np.array(left, dtype=np.int64), "end": start + part["size"].to_numpy() + np.array(right, dtype=np.int64)})


def cut(data: bytes, spans: list) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the spans, and the spans merged."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted((max(0, s["start"]), min(len(data), s["end"])) for s in spans):
        if merged and a <= merged[-1][1] + 1:  # nothing, or one blank, between
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    parts, at = [], 0
    for a, b in merged:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts), merged


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``rid, start, end`` (bytes) of what repeats, from texts ``rid, data`` with distinct numbers; the least number's occurrence stays."""
    spark = texts.sparkSession
    hashes = texts.mapInArrow(_hashes, "h long, n int, i int, rid long")
    firsts = hashes.groupBy("h").agg(F.sum("n").alias("n"), F.min("rid").alias("first")).where("n > 1").select("h", "first")
    firsts = staged(firsts, "line_firsts")
    if firsts.count() <= BROADCAST_FIRSTS:
        table = firsts.orderBy("h").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("h", "first")))
        found = texts.mapInArrow(_by_table(shared), _FOUND_DDL)
    else:
        answers = hashes.select("h", "rid").join(firsts, "h").groupBy("rid").agg(F.collect_list("h").alias("hashes"), F.collect_list("first").alias("firsts"))  # of one text
        found = texts.join(answers, "rid").mapInArrow(_by_join, _FOUND_DDL)
    found = staged(found, "line_repeats")
    beside = [F.col(c).alias(f"r_{c}") for c in ("body", "before", "after")]
    leads = found.where("lead").select("h", *beside)
    same = found.where("not lead").join(leads, "h").where(F.col("body") == F.col("r_body"))
    side = lambda name: F.when(F.col("edge"), F.col(name)).otherwise(F.lit(b"")).alias(name)
    spans = same.select("rid", "start", F.octet_length("body").alias("size"), "before", "after", side("r_before"), side("r_after"))
    spans = spans.mapInPandas(_spans, "rid long, start long, end long").groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    spans = staged(spans, "line_spans")
    discard(firsts, found)
    return spans


def numbered(docs: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The rows, and a column that numbers them: the key where it is a whole number, never null and never repeated; else generated numbers, fixed by a written table."""
    if dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        n, distinct = docs.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if n == distinct:
            return docs, F.col(key).cast("long")
    return staged(docs.withColumn("__rid", F.monotonically_increasing_id()), "line_texts"), F.col("__rid")


def remove_repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated chunks, and ``removed`` (array of [start, end) in bytes of the old text).

    The occurrence with the least key stays, within a text the first. Where keys aren't
    whole numbers, or are null or repeated, row order takes their place. Null texts
    stay null; empty texts and texts of one short line have no chunk. Rows that
    repeat lose their chunks like any other. Existing columns named
    ``removed`` are replaced. ``docs`` is read several times: stage it first if it is costly or changes between reads.
    """
    names = [c for c in docs.columns if c != "removed"]
    rows, rid = numbered(docs.select(*names), key)
    spans = repeated_spans(rows.select(rid.alias("rid"), text_bytes(text).alias("data")).where(F.octet_length("data") >= LEAST_BYTES))
    small = spans.count() <= BROADCAST_ROWS

    def remove(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        both = [("", []) if s is None else cut(x, s) for x, s in zip(bodies, spans, strict=True)]
        return pd.DataFrame({"text": [x.decode(errors="ignore") if m else None for x, m in both], "removed": [[list(s) for s in m] for _, m in both]})

    own = rows.select(F.struct(*names).alias("row"), rid.alias("rid"))
    joined = own.join(F.broadcast(spans) if small else spans.hint("shuffle_hash"), "rid", "left")
    some = F.when(F.col("spans").isNotNull(), F.col("row").getField(text).cast("binary"))  # other texts don't go to Python
    joined = joined.withColumn("new", F.pandas_udf(remove, "text string, removed array<array<long>>")(some, F.col("spans")))
    body = F.when(F.size("new.removed") > 0, F.col("new.text")).otherwise(F.col("row").getField(text))
    return joined.select(*[body.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names], "new.removed")
