"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

(Chakraborty, Goldenberg & Koucky, 2016; Zhang & Zhang, 2017.) The CGK walk
reads words with a pointer that, after each step, stays or advances by a
random bit of step and word, so that texts of small edit distance get outputs
of small Hamming distance. A table of the LSH has a walk of its own and keeps
a random sample of the output's places; equal samples in any table propose that a
window of the document holds the item. The window is aligned with the item,
and the exact edit distance in words decides.

Items fall into classes of like size. A document's windows of a class' size start at every
place; those with fewer words of the class' items than any match needs are left
out first. The walk is as long as the smallest item of the class needs, and a walk ends as
soon as no item of its table has the sample so far. An item of m words is
found where some stretch of the document is within
floor(m / 5) word edits of it (similarity 0.8). The number of tables of each class follows from RECALL:
copies of its items with as many edits as are allowed show how often a table finds one. Where MOST_TABLES
don't reach it, every window of the class' size is verified.

Items of more than LONG words are proposed by their segments: of s equal parts one is within a share 1 / s of
the edits, and so within those allowed to a part of its size. The whole item is verified then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import word_blocks

SIMILARITY = 0.8
#: Least share of copies with all the edits allowed that the tables have to propose, and the most tables for it.
RECALL, MOST_TABLES = 0.99, 128
#: Words of the longest item that is walked whole.
LONG = 96
#: Places of a walk's output in a sample.
SAMPLE = 3
#: Sizes of the items in a class differ by this factor at most.
SPREAD = 1.2
#: Edited copies of a class' items from which its number of tables follows, and tables that are tried on them at a time.
COPIES, TRIED = 256, 8
#: Items (40 bytes a table each, and so 256 MB at the most tables), and bytes of items, whose index is broadcast at once; more items are gone through in blocks.
ITEMS, ITEM_BYTES = 50_000, 4 << 20
#: Words of documents that are embedded at once.
WORDS_AT_ONCE = 1 << 19
_GAP = 8  # foreign words between documents
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<item_id: long, start: int, end: int, edits: int, words: int>>"


def allowed(m):
    """Word edits that an item of m words may differ by."""
    return np.floor(np.asarray(m) * (1 - SIMILARITY) + 1e-9).astype(np.int64)


@dataclass
class Class:
    """Tables of the items of like size: walks, samples, and the samples' prefixes that items have."""

    sizes: tuple[int, int]
    known: np.ndarray  # whether a word is in one of the items
    steps: np.ndarray  # (tables, SAMPLE), ascending
    turns: np.ndarray  # (tables, steps of the walk): odd numbers that decide whether to advance
    prefixes: list[np.ndarray]  # sorted, for each length
    keys: np.ndarray  # sorted whole samples
    owner: np.ndarray  # the segments that they are of
    all: np.ndarray | None = None  # the segments of the class, where the tables don't reach the recall


@dataclass
class Items:
    """Vocabulary and words of a block of items, and the classes of their sizes."""

    ids: list[int | None]
    words: list[np.ndarray]
    number: dict[bytes, int]
    names: np.ndarray  # a random number for each word
    segments: np.ndarray  # (segments, 3): the item, the word of it that the segment begins at, and its words
    classes: list[Class]


def walk(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray, steps: np.ndarray, turns: np.ndarray, prefixes: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts a walk at each of ``starts`` in each table: those left (number of the start), their whole samples, and the samples' prefixes.

    With ``prefixes`` a walk ends where its sample so far is none of them. Beyond ``ends`` a walk reads one word that no text has.
    """
    tables = len(steps)
    table, which = np.repeat(np.arange(tables), len(starts)), np.tile(np.arange(len(starts)), tables)
    at, key, taken = starts[which], _ODD * (table.astype(np.uint64) + np.uint64(1)), np.zeros(len(which), dtype=np.int64)
    out: list[list[np.ndarray]] = [[] for _ in range(steps.shape[1])]
    done, samples = [], []
    for step in range(int(steps.max(initial=-1)) + 1):
        name = np.where(at < ends[which], names[ids[np.minimum(at, len(ids) - 1)]], np.uint64(1))
        now = np.flatnonzero(steps[table, taken] == step)
        if len(now):
            key[now] = (key[now] ^ name[now]) * _ODD
            key[now] ^= key[now] >> np.uint64(29)
            live = np.ones(len(at), dtype=bool)
            for length in range(steps.shape[1]):
                here = now[taken[now] == length]
                out[length].append(key[here])
                if prefixes is not None and len(here):
                    k = np.searchsorted(prefixes[length], key[here]).clip(max=len(prefixes[length]) - 1)
                    live[here[prefixes[length][k] != key[here]]] = False
            taken[now] += 1
            whole = live & (taken == steps.shape[1])
            done.append(which[whole])
            samples.append(key[whole])
            live &= ~whole
            table, which, at, key, taken, name = (x[live] for x in (table, which, at, key, taken, name))
        if not len(at):
            break
        at = at + (name * turns[table, step] >> np.uint64(63)).astype(np.int64)
    join = lambda xs, kind: np.concatenate([*xs, np.zeros(0, dtype=kind)])
    return join(done, np.int64), join(samples, np.uint64), [join(x, np.uint64) for x in out]


def edited(words: np.ndarray, edits: int, draw: np.random.Generator, other: int) -> np.ndarray:
    """A copy with that many words replaced (by ``other``), left out or put in at random places."""
    out = words.tolist()
    for _ in range(edits):
        i, kind = int(draw.integers(len(out))), int(draw.integers(3))
        if kind == 0 or len(out) == 1:
            out[i] = other
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, other)
    return np.array(out, dtype=np.int64)


def _laid(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another: their words, starts and ends."""
    ends = np.cumsum([len(w) for w in words])
    return np.concatenate(words), ends - [len(w) for w in words], ends


def _tables(own: list[np.ndarray], names: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray, bool]:
    """Samples and turns of as many tables as RECALL asks for, tried on edited copies of the items, and whether they reach it."""
    least = min(map(len, own))
    length = max(1, -(-3 * least // 2))
    z = min(SAMPLE, length)
    copies, source = [], []
    for i in draw.integers(len(own), size=COPIES if allowed(max(map(len, own))) else 0):
        copies.append(edited(own[i], int(allowed(len(own[i]))), draw, len(names) - 1))
        source.append(int(i))
    steps, turns, missed = [], [], np.ones(len(copies), dtype=bool)
    tried = TRIED if copies else 1  # without edits one table finds all
    while not steps or (missed.sum() > (1 - RECALL) * len(copies) and len(steps) * TRIED < MOST_TABLES):
        # the first place early in the walk, so that most walks end soon; the others anywhere behind
        first = draw.integers(max(1, length // 4), size=tried)
        steps.append(np.array([sorted([f, *(f + 1 + draw.choice(length - f - 1, z - 1, replace=False))]) if z > 1 else [f] for f in first.tolist()]))
        turns.append(draw.integers(1 << 63, size=(tried, length), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        if copies:
            ids, starts, ends = _laid([own[i] for i in source])
            a, key_a, _ = walk(ids, starts, ends, names, steps[-1], turns[-1])
            ids, starts, ends = _laid(copies)  # a document's windows start at each word: also at the first ones of a copy
            late = np.minimum(starts[:, None] + np.arange(int(allowed(max(map(len, own)))) + 1), ends[:, None] - 1)
            copy = np.repeat(np.arange(len(copies)), late.shape[1])
            b, key_b, _ = walk(ids, late.ravel(), ends[copy], names, steps[-1], turns[-1])
            b = copy[b]
            both = np.intersect1d(a.astype(np.uint64) * _ODD ^ key_a, b.astype(np.uint64) * _ODD ^ key_b)
            missed[b[np.isin(b.astype(np.uint64) * _ODD ^ key_b, both)]] = False
    return np.concatenate(steps), np.concatenate(turns), bool(missed.sum() <= (1 - RECALL) * len(copies))


def _segments(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Items, those of more than LONG words in equal parts, and the item, first word and words of each."""
    parts, where = [], []
    for i, w in enumerate(words):
        at = 0
        for part in np.array_split(w, -(-len(w) // LONG)):
            parts.append(part)
            where.append((i, at, len(part)))
            at += len(part)
    return parts, np.array(where, dtype=np.int64).reshape(-1, 3)


def index_items(rows: list[tuple[int | None, str | None]]) -> Items:
    """Items without words are left out."""
    number: dict[bytes, int] = {}
    ids, words = [], []
    for item, text in rows:
        w = [x for block in word_blocks((text or "").encode()) for x in block]
        if w:
            ids.append(item)
            words.append(np.array([number.setdefault(x, len(number) + 1) for x in w], dtype=np.int64))
    draw = np.random.default_rng(5)
    names = draw.integers(1, 1 << 63, len(number) + 2, dtype=np.uint64)  # the first for words of no item, the last for edits
    parts, segments = _segments(words)
    order, classes = sorted(range(len(parts)), key=lambda i: len(parts[i])), []
    while order:
        least = len(parts[order[0]])
        part = [i for i in order if len(parts[i]) <= SPREAD * least]
        order = order[len(part) :]
        own = [parts[i] for i in part]
        steps, turns, reached = _tables(own, names, draw)
        flat, starts, ends = _laid(own)
        which, keys, prefixes = walk(flat, starts, ends, names, steps, turns)
        known = np.zeros(len(names), dtype=bool)
        known[flat] = True
        by = np.argsort(keys, kind="stable")
        classes.append(Class((least, len(own[-1])), known, steps, turns, [np.unique(x) for x in prefixes], keys[by], np.array(part)[which[by]], None if reached else np.array(part)))
    return Items(ids, words, number, names, segments, classes)


def word_places(item: list[int]) -> dict[int, int]:
    """For each word the bits of its places in the item."""
    out: dict[int, int] = {}
    for i, x in enumerate(item):
        out[x] = out.get(x, 0) | 1 << i
    return out


def distances(places: dict[int, int], m: int, text: list[int], anchored: bool = False) -> Iterator[int]:
    """Edits between an item and the nearest stretch that ends at each place of ``text`` (anchored: that begins where ``text`` does), from
    before its first word on, by Myers' bit vectors: a column of the table in a few integer operations."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    yield score
    for word in text:
        eq = places.get(word, 0)
        diagonal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        yield score
        vertical = eq | down
        plus, minus = (plus << 1 | anchored) & full, minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical


def least_edits(places: dict[int, int], m: int, text: list[int]) -> int:
    """The distance that ``align`` gives; the loop of ``distances`` once more, as most windows end here."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, get = m, places.get
    for word in text:
        eq = get(word, 0)
        diagonal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        vertical = eq | down
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
    return best


def align_long(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """Like ``align``, in far fewer steps, with the shortest stretch of those that end first: its end by the distances, its start by those of what is reversed."""
    found = list(distances(word_places(item), len(item), text))
    best = min(found)
    end = found.index(best)
    back = distances(word_places(item[::-1]), len(item), text[:end][::-1], anchored=True)
    return best, end - next(i for i, d in enumerate(back) if d == best), end


def align(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """Least word edits between ``item`` and a stretch of ``text``, and that stretch (the earliest, then longest-started, of the best)."""
    dist, start = list(range(len(item) + 1)), [0] * (len(item) + 1)
    best = (dist[-1], 0, 0)
    for j, word in enumerate(text):
        last_d, last_s = dist[0], start[0]
        dist[0], start[0] = 0, j + 1
        for i, x in enumerate(item, 1):
            d, s = last_d + (x != word), last_s
            if dist[i] + 1 < d:
                d, s = dist[i] + 1, start[i]
            if dist[i - 1] + 1 < d:
                d, s = dist[i - 1] + 1, start[i - 1]
            last_d, last_s, dist[i], start[i] = dist[i], start[i], d, s
        if dist[-1] < best[0]:
            best = (dist[-1], start[-1], j + 1)
    return best


def _windows(items: Items, ids: np.ndarray, starts: np.ndarray, to: np.ndarray, segment: int) -> np.ndarray:
    """``(window start, segment)`` of all windows that have as many of the segment's words as a match needs."""
    item, before, m = items.segments[segment].tolist()
    known = np.zeros(len(items.names), dtype=bool)
    known[items.words[item][before : before + m]] = True
    many = np.concatenate([[0], np.cumsum(known[ids])])
    starts = starts[many[to[starts]] - many[starts] >= m - int(allowed(m))]
    return np.stack([starts, np.full(len(starts), segment)], axis=1)


def _proposals(items: Items, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distinct ``(window start, segment)``; ``ends`` has where the text of each place ends."""
    found = []
    for c in items.classes:
        least, most = c.sizes
        own = c.known[ids]
        many = np.concatenate([[0], np.cumsum(own)])
        to = np.minimum(np.arange(len(ids)) + most + int(allowed(most)), ends)
        # a match has at most so many foreign words, within the longest window; its first word, or one soon after, is the item's
        starts = np.flatnonzero(own & (many[to] - many[:-1] >= least - int(allowed(least))))
        if c.all is not None:
            found += [_windows(items, ids, starts, to, segment) for segment in c.all.tolist()]
            continue
        for part in np.array_split(starts, max(1, len(starts) * len(c.steps) // 2_000_000)):
            which, key, _ = walk(ids, part, ends[part], items.names, c.steps, c.turns, c.prefixes)
            low = np.searchsorted(c.keys, key, side="left")
            n = np.searchsorted(c.keys, key, side="right") - low
            place = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.unique(np.stack([np.repeat(part[which], n), c.owner[place]], axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


def find(items: Items, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
    """For each text ``(item number, first word, end word, edits)``; matches of an item in a text don't overlap."""
    out: list[list] = [[] for _ in texts]
    if not items.words:
        return out
    lengths = np.array([len(w) for w in items.words])
    edits = allowed(lengths)
    lists = [w.tolist() for w in items.words]
    places = [word_places(w) for w in lists]
    margin = int((lengths + 4 * edits).max()) + _GAP
    gap = np.zeros(_GAP, dtype=np.int64)
    parts, where, size = [], [], 0  # where: text, place of the part in the text, place in the whole

    def flush():
        ids = np.concatenate(parts)
        begin = np.array([w[2] for w in where])
        end = begin + np.array([len(p) for p in parts[::2]])
        done: dict[tuple[int, int], list] = {}
        stops = np.repeat(end, np.diff(np.append(begin, len(ids))))
        for at, segment in _proposals(items, ids, np.maximum(stops, np.arange(len(ids)))).tolist():
            item, before, _ = items.segments[segment].tolist()
            m, k = len(lists[item]), int(edits[item])
            near = 2 * k if m > LONG else k  # words before a segment may have edits too
            i = int(np.searchsorted(begin, at, side="right")) - 1
            at -= before
            a, b = max(at - near, int(begin[i])), min(at + m + near, int(end[i]))
            if b <= a or any(x <= at + k and at - k <= y for x, y in done.get((i, item), ())):
                continue  # the window is seen already
            window = ids[a:b].tolist()
            if sum(map(places[item].__contains__, window)) >= m - k and least_edits(places[item], m, window) <= k:
                d, s, e = (align_long if m > LONG else align)(lists[item], window)
                text, base, place = where[i]
                out[text].append((item, a + s - place + base, a + e - place + base, d))
                done.setdefault((i, item), []).append((at, at))
        parts.clear()
        where.clear()

    for t, data in enumerate(texts):
        base, tail = 0, np.zeros(0, dtype=np.int64)
        for words in word_blocks(data):
            get = items.number.get
            ids = np.concatenate([tail, np.array(list(map(get, words, repeat(0))), dtype=np.int64)])
            where.append((t, base, size))
            parts += [ids, gap]
            size += len(ids) + _GAP
            base += len(ids) - min(len(ids), margin)
            tail = ids[-margin:]  # so that no window is cut at the end of a block
            if size > WORDS_AT_ONCE:
                flush()
                size = 0
    if parts:
        flush()
    for t, found in enumerate(out):
        kept: list[tuple] = []
        for x in sorted(set(found), key=lambda x: (x[3], x[1], x[2], x[0])):
            if all(x[0] != y[0] or x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        out[t] = sorted(kept, key=lambda x: (x[1], x[2], x[0]))
    return out


def _places(text: str, words: list[tuple]) -> dict[int, tuple[int, int]]:
    wanted = {w for x in words for w in (x[1], x[2] - 1)}
    return {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in wanted}


def _searcher(shared):
    """The function of a pandas UDF, over the items that ``shared`` broadcasts."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = shared.value
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                some = texts.iloc[at : at + 512].tolist()
                for text, hits in zip(some, find(items, [x.encode() for x in some]), strict=True):
                    place = _places(text, hits) if hits else {}
                    out.append([{"item_id": items.ids[i], "start": place[a][0], "end": place[b - 1][1], "edits": d, "words": len(items.words[i])} for i, a, b, d in hits])
            yield pd.Series(out)

    return look


def matches(benchmark: DataFrame, text: Column, *, item: str = "item_id", item_text: str = "text") -> Column:
    """A column of type MATCH: the benchmark items that ``text`` holds, by place, in code points.

    Null and empty texts hold none; items without words match nothing; items
    that repeat are reported each. The items are read here, in blocks of about
    ITEM_BYTES; each block's index is built once and broadcast.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t") + 8), F.lit(0))).first()
    blocks = max(1, -(-size // ITEM_BYTES), -(-n // ITEMS))
    found = []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()  # about ITEM_BYTES
        shared = spark.sparkContext.broadcast(index_items([(r["i"], r["t"]) for r in part]))

        found.append(F.pandas_udf(_searcher(shared), MATCH)(F.coalesce(text, F.lit(""))))
    return found[0] if blocks == 1 else F.array_sort(F.concat(*found))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per match: doc_id, item_id, start, end, edits, similarity."""
    hits = docs.select(F.col(key).cast("long").alias("doc_id"), matches(benchmark, F.col(text)).alias("m"))
    return hits.select("doc_id", F.inline("m")).select("doc_id", "item_id", "start", "end", "edits", (1 - F.col("edits") / F.col("words")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    hit = "__matches"
    return docs.withColumn(hit, matches(benchmark, F.col(text))).where(F.size(hit) == 0).drop(hit)
