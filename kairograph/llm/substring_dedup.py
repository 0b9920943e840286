"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

Suffixes begin at words. Of the suffixes that begin in a window of WINDOW words
and share PREFIXES[0] words or more with it, the one whose first words hash
lowest stands for the window, with the words before it: windows of equal words
choose alike, and neighbours mostly share a suffix, so that one in twenty is
kept (a sparse suffix tree). A suffix belongs to the group of its first words.
Groups of one document are dropped, equal suffixes are told apart by their
documents alone, and what is left of a group (GROUP suffixes at most) becomes a
subtree in a task's memory: sorted suffixes with the words that neighbours
share. Nodes so deep that the words after a place and those before it make a
window are the repeats; of the documents below a node the smallest keeps them.
A group that is too large is split by longer prefixes, PREFIXES in turn, the last of
which are whole windows, which need a grouped minimum and no tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged, text_bytes
from .line_dedup import numbered

#: Words of a window: shorter repeats stay.
WINDOW = 50
#: Words that the suffixes of a group share; larger groups are split by the next.
PREFIXES = (8, 24, WINDOW)
#: Suffixes of a group (some 500 bytes each) that become one subtree at most.
GROUP = 20_000
#: Bytes of text that are sampled at once.
BLOCK = 1 << 18
_BITS = np.uint64(20)  # for a word's place in a block


def normal(data: bytes) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join(data.split())


def pieces(data: bytes, size: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """Number of the first word, and text, of parts of a normal text that have WINDOW - 1 words in common, so that each window lies in one."""
    at, number = 0, 0
    while True:
        end = data.find(b" ", at + size) if len(data) - at > size else -1
        tail = data[at:end].rsplit(b" ", WINDOW - 1) if end >= 0 else []
        while end >= 0 and len(tail) < WINDOW:  # words that are long
            end = data.find(b" ", end + size)
            tail = data[at:end].rsplit(b" ", WINDOW - 1) if end >= 0 else []
        if end < 0:
            yield number, data[at:]
            return
        yield number, data[at:end]
        number += tail[0].count(b" ") + 1
        at += len(tail[0]) + 1


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0xD6E8FEB86659FD93
_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    size = 1 << max(BLOCK.bit_length(), n.bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        tables = [np.full(size, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for table in tables:
            table[0] = 1
        _TABLES[size] = tuple(np.cumprod(x, dtype=np.uint64) for x in tables)
    return _TABLES[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _sums(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])


def sampled(block: bytes, prefix: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Suffixes that stand for the windows of normal texts, which newlines part: the text, the word it begins at, its
    first and its last window (as words of the block), the hash of its first ``prefix`` words; and where the block's
    words begin and end. ``wanted``, if there, tells which of the words may begin a window."""
    d = np.frombuffer(block, dtype=np.uint8)
    part = d == 0x0A
    gap = np.flatnonzero(part | (d == 0x20))
    begin, end = np.append(0, gap + 1), np.append(gap, len(d))
    owner = np.zeros(len(begin), dtype=np.int64)
    owner[1:] = np.cumsum(part[gap])
    none = np.zeros(0, dtype=np.int64)
    last = len(begin) - WINDOW
    if last < 0:
        return none, none, none, none, none, begin, end
    power, inverse = _powers(len(d) + 1)
    sums = _sums(_VALUES[d], power)
    words = _mixed((sums[end] - sums[begin]) * inverse[begin])
    sums = _sums(words, power)
    n = len(words) - prefix + 1
    grams = _mixed((sums[prefix:] - sums[:n]) * inverse[:n])
    key = grams >> _BITS << _BITS | np.arange(n, dtype=np.uint64)  # the first among equals
    wide, size = WINDOW - prefix + 1, 1
    while size * 2 <= wide:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < wide:
        key = np.minimum(key[: size - wide], key[wide - size :])
    valid = owner[: last + 1] == owner[WINDOW - 1 :]
    if wanted is not None:
        valid &= wanted[: last + 1]
    window = np.flatnonzero(valid)
    if not len(window):
        return none, none, none, none, none, begin, end
    at = (key[window] & (np.uint64(1) << _BITS) - np.uint64(1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(window) != 1)))
    low, high = window[new], window[np.append(new[1:], len(window)) - 1]
    return owner[low], at[new], low, high, grams[at[new]].view(np.int64), begin, end


_SAMPLES = pa.schema([("rid", pa.int64()), ("doc", pa.int64()), ("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("low", pa.int32()), ("n", pa.int16()), ("off", pa.int16())])
_SAMPLES_DDL = "rid long, doc long, a long, c1 long, c2 long, low int, n short, off short"


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Rows and first words of pieces of the batch's ``data``, and the pieces, joined up to BLOCK."""
    named, held, size = [], [], 0
    for row in range(batch.num_rows):
        for number, piece in pieces(normal(batch.column("data")[row].as_py())):
            if held and size + len(piece) > BLOCK:
                yield named, b"\n".join(held)
                named, held, size = [], [], 0
            named.append((row, number))
            held.append(piece)
            size += len(piece) + 1
    if held:
        yield named, b"\n".join(held)


def _sampler(prefix: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the suffixes that stand for the texts' windows, or for those in the column ``ranges`` (first window, number) if it is there."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "doc"))
            ranges = [[(r["low"], r["n"]) for r in rs] for rs in batch.column("ranges").to_pylist()] if "ranges" in batch.schema.names else None
            for named, block in _blocks(batch):
                wanted = None
                if ranges is not None:
                    wanted = np.zeros(block.count(b" ") + len(named), dtype=bool)
                    at = 0
                    for (row, number), piece in zip(named, block.split(b"\n"), strict=True):
                        size = piece.count(b" ") + 1
                        for low, n in ranges[row]:
                            wanted[at + max(0, low - number) : at + max(0, min(size, low + n - number))] = True
                        at += size
                text, s, low, high, a, begin, end = sampled(block, prefix, wanted)
                if not len(s):
                    continue
                cuts = zip(begin[low].tolist(), end[high + WINDOW - 1].tolist(), strict=True)
                c = np.frombuffer(b"".join([hashlib.blake2b(block[i:j], digest_size=16).digest() for i, j in cuts]), dtype="<i8").reshape(-1, 2)
                opens = np.flatnonzero(np.append(True, begin[1:] - end[:-1] == 1) & np.append(True, np.frombuffer(block, dtype=np.uint8)[begin[1:] - 1] == 0x0A))  # first words of the pieces
                row, number = (np.array(x, dtype=np.int64) for x in zip(*named, strict=True))
                place = low - opens[text] + number[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (rid[row[text]], doc[row[text]], a, c[:, 0], c[:, 1], place.astype(np.int32), (high - low + 1).astype(np.int16), (s - low).astype(np.int16))], schema=_SAMPLES)

    return sample


_BODIES = pa.schema([("a", pa.int64()), ("rid", pa.int64()), ("doc", pa.int64()), ("low", pa.int32()), ("n", pa.int16()), ("off", pa.int16()), ("body", pa.binary())])
_BODIES_DDL = "a long, rid long, doc long, low int, n short, off short, body binary"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the suffixes asked for, from a text each with ``asked``."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = normal(batch.column("data")[i].as_py())
            gap = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)
            begin, end = np.append(0, gap + 1), np.append(gap, len(data))
            asked = batch.column("asked")[i].values
            a, low, n, off = (asked.field(c) for c in ("a", "low", "n", "off"))
            first = low.to_numpy()
            cuts = zip(begin[first].tolist(), end[first + n.to_numpy() + WINDOW - 2].tolist(), strict=True)
            same = lambda name: pa.array(np.full(len(first), batch.column(name)[i].as_py(), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([a, same("rid"), same("doc"), low, n, off, pa.array([data[x:y] for x, y in cuts], pa.binary())], schema=_BODIES)


class Subtree:
    """A suffix tree over words as a sorted array: suffixes (rows of word numbers, 0 where they end; the first column is their group), and how many words each shares with the one before it."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
        ordered = rows[self.order]
        differ = ordered[1:] != ordered[:-1]
        self.shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix the number of the node at ``depth`` words of its own that it hangs below."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.append(0, np.cumsum(self.shared < depth + 1))
        return out


def repeated_windows(group: np.ndarray, doc: np.ndarray, bodies: list[bytes], off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For suffixes with the words before them: which of their windows (rows, windows) also begin in a document that is smaller.

    ``bodies`` are their windows' words, ``off`` is the word that the suffix begins at, ``n`` their windows.
    """
    words = [b.split(b" ") for b in bodies]
    sizes = np.array([len(w) for w in words])
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [x for w in words for x in w]
    ids = np.append(pd.factorize(flat)[0] + 1, 0).astype(np.uint32)
    opens = np.cumsum(sizes) - sizes
    of = (np.unique(group, return_inverse=True)[1] + 1).astype(np.uint32)[:, None]
    step = np.arange(WINDOW)
    after = (opens + off)[:, None] + step
    after = np.where(after < (opens + sizes)[:, None], after, len(flat))
    before = (opens + off)[:, None] - 1 - step[:-1]
    before = np.where(before >= opens[:, None], before, len(flat))
    right, left = Subtree(np.hstack([of, ids[after]])), Subtree(np.hstack([of, ids[before]]))
    found = np.zeros((len(bodies), WINDOW), dtype=bool)
    for o in range(WINDOW):  # words of the window before the suffix
        rows = np.flatnonzero((off >= o) & (off - n < o))
        if len(rows) < 2:
            continue
        node = right.nodes(WINDOW - o)[rows] * len(bodies) + left.nodes(o)[rows]
        order = np.lexsort((doc[rows], node))
        new = np.append(True, np.diff(node[order]) != 0)
        least = doc[rows][order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        over = rows[order[doc[rows][order] > least]]
        found[over, off[over] - o] = True
    return found


_SPANS_DDL = "rid long, start int, stop int"


def _trees(limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Spans of words that repeat, from whole groups of suffixes in order, some ``limit`` suffixes at once."""

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        off, n = rows["off"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
        found = repeated_windows(rows["a"].to_numpy(), rows["doc"].to_numpy(), list(rows["body"]), off, n)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        stop = np.nonzero(edge == -1)[1]
        low = rows["low"].to_numpy()[row]
        return pd.DataFrame({"rid": rows["rid"].to_numpy()[row], "start": low + start, "stop": low + stop - 1 + WINDOW})

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= limit:
                a = held["a"].to_numpy()
                whole = int(np.searchsorted(a, a[-1]))  # the last group may go on
                if whole:
                    yield spans(held.iloc[:whole])
                    held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield spans(held)

    return grow


def repeated_spans(texts: DataFrame, *, group: int = GROUP) -> DataFrame:
    """``rid, start, stop``: spans of words, not merged, of the windows that also begin in a text with a smaller ``doc``, from ``rid, doc, data``."""
    out, todo = [], texts
    for prefix in PREFIXES:
        samples = staged(todo.mapInArrow(_sampler(prefix), _SAMPLES_DDL), "passage_samples")
        # what is grouped by a join's key is written first, so that adaptive execution can split a hot key's rows
        many = staged(samples.groupBy("a").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("a"), "passage_groups")
        kept = staged(samples.join(many, "a", "left_semi"), "passage_suffixes")
        firsts = staged(kept.groupBy("c1", "c2").agg(F.min("doc").alias("first"), F.min("a").alias("a")), "passage_firsts")
        members = staged(kept.join(firsts.drop("a"), ["c1", "c2"]).drop("c1", "c2"), "passage_members")
        stop = (F.col("low") + F.col("n") + (WINDOW - 1)).cast("int").alias("stop")
        out.append(staged(members.where("doc > first").select("rid", F.col("low").alias("start"), stop), "passage_spans"))
        discard(samples, many)
        if prefix == WINDOW:
            discard(kept, firsts, members)
            break
        several = staged(firsts.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("a"), "passage_groups")
        left = members.where("doc = first").join(several, "a", "left_semi").drop("first")
        left = staged(left, "passage_asked")
        discard(kept, firsts, members, several)
        large = left.groupBy("a").count().where(F.col("count") > group).select("a", F.lit(True).alias("large"))
        asked = left.join(large, "a", "left")
        small = asked.where("large is null").groupBy("rid").agg(F.collect_list(F.struct("a", "low", "n", "off")).alias("asked"))  # of one text
        bodies = texts.join(small.hint("shuffle_hash"), "rid").mapInArrow(_bodies, _BODIES_DDL)
        out.append(staged(bodies.repartition("a").sortWithinPartitions("a").mapInPandas(_trees(group), _SPANS_DDL), "passage_spans"))
        large = asked.where("large")
        if not large.limit(1).count():
            break
        ranges = large.groupBy("rid").agg(F.collect_list(F.struct("low", "n")).alias("ranges"))  # of one text
        todo = texts.join(ranges.hint("shuffle_hash"), "rid")
    spans = out[0]
    for x in out[1:]:
        spans = spans.unionByName(x)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_CUT = "text string, n_words long, removed array<array<int>>"


def _cut(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
    texts, counts, gone = [], [], []
    for body, found in zip(bodies, spans, strict=True):
        words = (body or b"").split()
        both = [] if found is None else merged([(s["start"], s["stop"]) for s in found])
        counts.append(len(words))
        gone.append([list(x) for x in both])
        for a, b in reversed(both):
            del words[a:b]
        texts.append(None if body is None else b" ".join(words).decode())
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_words": counts, "removed": pd.Series(gone, dtype=object)})


def remove_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """All columns of ``docs``, ``text`` as the words that stay joined by one space, ``n_words`` of the old text, and ``removed``, its spans of words that went.

    A word goes if a window of WINDOW words over it also begins in a document with a smaller key (a whole number),
    before anything went. Rows with equal keys remove nothing from one another; rows with a null key lose nothing and
    remove nothing. Null texts stay null, and have no words as empty ones; texts may be of any length. Existing
    columns named ``n_words`` or ``removed`` are replaced. ``docs`` is read several times: stage it first if it is costly or changes between reads.
    """
    names = [c for c in docs.columns if c not in ("n_words", "removed")]
    quoted = [f"`{c}`" for c in names]
    rows, rid = numbered(docs.select(*quoted), key)
    texts = rows.select(rid.alias("rid"), F.col(key).cast("long").alias("doc"), text_bytes(text).alias("data"))
    spans = repeated_spans(texts.where(F.col("doc").isNotNull() & (F.octet_length("data") >= 2 * WINDOW - 1)), group=group)
    spans = staged(spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "passage_cuts")  # of one text
    joined = rows.select(F.struct(*quoted).alias("row"), rid.alias("rid")).join(spans.hint("shuffle_hash"), "rid", "left")
    new = F.pandas_udf(_cut, _CUT)(F.col("row").getField(text).cast("binary"), F.col("spans"))
    joined = joined.select("row", new.alias("new"))
    return joined.select(*[F.col("new.text" if c == text else f"row.`{c}`").alias(c) for c in names], "new.n_words", "new.removed")


#: DuckDB SQL of the query over ``documents``: every window is a string.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
g AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE doc_id > first),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS pos FROM g),
r AS (SELECT rid, list(pos) AS gone FROM x GROUP BY rid),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END AS kept FROM d LEFT JOIN r USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""
