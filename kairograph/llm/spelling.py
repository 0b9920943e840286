"""Spelling variants: words one edit apart, found by automata over halves of words.

If one edit leads from a word to another, then one half of the latter stands
unchanged at the former's start or end. Every word's two halves are patterns of
Aho-Corasick automata ("Efficient string matching", 1975). A half has at least
three code points, so that words with equal first (or last) three meet in the
same shard: a shard's automaton scans each of its words, a hit counts if its
offset and the lengths fit, and the pairs that it stands for are verified. The
words of crowded shards are dealt into blocks of which every two meet. No pair
leaves a task: a word's neighbours are counted and the most frequent is kept.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged

#: Least code points of a word, and least occurrences.
LEAST, TIMES = 7, 2
#: What parts runs of letters: all but ASCII letters and U+00C0 to U+00FF (Java's engine tests this ten times as fast as their complement).
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\xBF\x{100}-\x{10FFFF}]+"
#: Code points of which every half has at least as many, and that choose its shard.
SIDE = LEAST // 2
#: One of so many runs of a document loses a code point.
DROPPED = 31
#: A word's form occurs so many times as often, at least.
RATIO = 10
#: Words that meet in one task, or are dealt into blocks of as many.
SHARD = 60_000
#: Pairs that are verified at once.
PAIRS = 1 << 22


def runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``word``: every run of at least LEAST letters, A-Z lower-cased, some without a code point that the document's key chooses."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.split(low, BETWEEN)).alias("run")).where(F.length("run") >= LEAST)
    run = F.col("run")
    rows = rows.select("run", F.crc32(F.concat_ws(":", "key", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % DROPPED == 0, cut).otherwise(run).alias("word")).where(F.length("word") >= LEAST)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the words that occur TIMES times or more."""
    return runs(docs, key, text).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES)


_DEALT = "side int, shard int, i int, j int, word string, n long, pattern boolean, scanned boolean"


def dealt(words: DataFrame, size: int = SHARD) -> DataFrame:
    """The words, once for their start and once for their end, in blocks ``(side, shard, i, j)`` of ``size`` at most, or nearly.

    Of a crowded shard, the patterns of block i and the words of block j meet in ``(i, j)``.
    """
    shards = max(1, -(-words.count() // size))
    ends = F.array(F.substring("word", 1, SIDE), F.substring("word", -SIDE, SIDE))
    rows = words.select("word", "n", F.posexplode(ends).alias("side", "end"))
    rows = rows.select("side", F.pmod(F.xxhash64("end"), F.lit(shards)).cast("int").alias("shard"), "word", "n")
    # words / size rows for each side: a table of counts, some 20 bytes a row, that stays 1 / size of the words
    blocks = rows.groupBy("side", "shard").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(blocks), ["side", "shard"])
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    k, own = F.col("k"), F.col("own")
    place = lambda i, j, pattern, scanned: F.struct(i.alias("i"), j.alias("j"), pattern.alias("pattern"), scanned.alias("scanned"))
    true, false = F.lit(True), F.lit(False)
    both = F.array_compact(F.array(place(own, k, true, k == own), F.when(k != own, place(k, own, false, true))))
    return rows.select("side", "shard", "word", "n", F.explode(both).alias("x")).select("side", "shard", "x.i", "x.j", "word", "n", "x.pattern", "x.scanned")


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` and of ``y`` (signs, by length) are exactly one edit apart, as a matrix; their lengths differ by one at most."""
    (a, m), (b, n) = x.shape, y.shape
    if m == n:
        wrong = np.zeros((a, b), dtype=np.uint8)  # a word has fewer than 256 wrong signs beyond the first, or the count stops
        for k in range(m):
            wrong += (x[:, k, None] != y[None, :, k]) & (wrong < 2)
        return wrong == 1
    least = min(m, n)
    shared = np.zeros((a, b), dtype=np.int32)
    for side in (range(least), range(-1, -least - 1, -1)):
        same = np.ones((a, b), dtype=bool)
        for k in side:
            same &= x[:, k, None] == y[None, :, k]
            shared += same
    return shared >= least


def _near(x: str, y: str) -> bool:
    """The same for two words."""
    if len(x) > len(y):
        x, y = y, x
    k = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x != y and (x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else x[k:] == y[k + 1 :])


class Shard:
    """The words of a block: those whose halves on one side are patterns, by descending count and then by code points, and those that are scanned."""

    def __init__(self, side: int, patterns: list[str], counts: list[int]):
        order = sorted(range(len(patterns)), key=lambda i: (-counts[i], patterns[i]))
        self.side, self.words, self.counts = side, [patterns[i] for i in order], [counts[i] for i in order]
        self.halves: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            half = len(w) // 2
            self.halves.setdefault(w[half:] if side else w[:half], []).append(i)
        self.automaton = ahocorasick.Automaton()
        for number, half in enumerate(self.halves):
            self.automaton.add_word(half, (number, len(half)))
        self.automaton.make_automaton()

    def hits(self, scanned: list[str]) -> dict[int, list[int]]:
        """For each half the scanned words that it begins (or ends)."""
        found: dict[int, list[int]] = {}
        for x, word in enumerate(scanned):
            last = len(word) - 1
            for end, (number, size) in self.automaton.iter(word):
                if end == last if self.side else end == size - 1:
                    found.setdefault(number, []).append(x)
        return found

    def _compared(self, xs: list[str], ys: list[int], half: str) -> Iterator[tuple[int, int, int]]:
        """Number in ``xs``, near words, and the first of them, where there are some; ``ys`` are of one length, ``xs`` of one too."""
        cut = (lambda w: w[: len(w) - len(half)]) if self.side else (lambda w: w[len(half) :])
        first = len(self.words[ys[0]]) // 2  # where a last half's words also share the first half, they met there
        new = lambda x, y: not self.side or x[:first] != y[:first]
        if len(xs) * len(ys) <= 32:
            for i, x in enumerate(xs):
                near = [y for y in ys if _near(cut(x), cut(self.words[y])) and new(x, self.words[y])]
                if near:
                    yield i, len(near), near[0]
            return
        signs = lambda words: np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)
        right = [self.words[y] for y in ys]
        for low in range(0, len(ys), wide := max(1, min(len(ys), PAIRS))):
            part = right[low : low + wide]
            y, y_first = signs([cut(w) for w in part]), signs([w[:first] for w in part])
            for at in range(0, len(xs), step := max(1, PAIRS // len(part))):
                some = xs[at : at + step]
                near = one_edit(signs([cut(w) for w in some]), y)
                if self.side and near.any():
                    x_first = signs([w[:first] for w in some])
                    a, b = np.nonzero(near)
                    met = (x_first[a] == y_first[b]).all(axis=1)
                    near[a[met], b[met]] = False
                total = near.sum(axis=1)
                best = near.argmax(axis=1)
                for i in np.flatnonzero(total).tolist():
                    yield at + i, int(total[i]), ys[low + int(best[i])]

    def near(self, scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each scanned word how many near words this shard finds, and the first of them (or -1)."""
        total, best = np.zeros(len(scanned), dtype=np.int64), np.full(len(scanned), len(self.words), dtype=np.int64)
        halves = list(self.halves)
        for number, xs in self.hits(scanned).items():
            half = halves[number]
            of: dict[int, list[int]] = {}
            for y in self.halves[half]:
                of.setdefault(len(self.words[y]), []).append(y)
            lengths: dict[int, list[int]] = {}
            for x in xs:
                lengths.setdefault(len(scanned[x]), []).append(x)
            for size, ys in of.items():
                for other in (size - 1, size, size + 1):
                    if group := lengths.get(other):
                        for i, n, y in self._compared([scanned[x] for x in group], ys, half):
                            total[group[i]] += n
                            best[group[i]] = min(best[group[i]], y)
        return total, np.where(total > 0, best, -1)


def _found(rows: pd.DataFrame) -> pd.DataFrame:
    patterns, scanned = rows[rows["pattern"]], rows.loc[rows["scanned"], "word"].tolist()
    shard = Shard(int(rows["side"].iloc[0]), patterns["word"].tolist(), patterns["n"].tolist())
    total, best = shard.near(scanned)
    at = np.flatnonzero(total)
    said = lambda xs: pd.Series(xs, dtype=object)
    return pd.DataFrame({"word": said([scanned[i] for i in at]), "n_near": total[at], "form": said([shard.words[best[i]] for i in at]), "form_n": np.array([shard.counts[best[i]] for i in at], dtype=np.int64)})


def neighbours(words: DataFrame, *, size: int = SHARD) -> DataFrame:
    """``word, n_near, form, form_n`` of the words that have near ones among ``words`` (``word, n``, distinct): how many, and the most frequent."""
    found = dealt(words, size).groupBy("side", "shard", "i", "j").applyInPandas(_found, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form`` (no word twice): where following forms ends. A form is RATIO times as frequent
    as its word, so that chains have fewer than twenty steps; each round doubles the steps."""
    cur = staged(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cur.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        joined = staged(joined, "spelling_roots")
        discard(cur)
        cur = joined
        if not cur.where("moved").limit(1).count():
            return cur.select("word", "root")


def group_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the documents.

    Words are runs of letters (ASCII and U+00C0 to U+00FF) of at least LEAST code points that occur TIMES times or more;
    ``form`` is the near word (one code point inserted, deleted or replaced) that occurs most, by code points among
    equals, if it occurs RATIO times as often as the word, else null as ``form_n`` is; ``root`` is the last form of forms.

    A null key reads as the empty text, null texts have no words, and rows that repeat count again, since a row is a
    document. Texts and words may be of any length. Other columns aren't read. Without words the result is empty.
    """
    words = staged(vocabulary(docs, key, text), "spelling_words")
    near = words.select("word", "n").join(neighbours(words, size=size), "word", "left")
    often = F.col("form_n") >= RATIO * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n"))
    near = staged(near, "spelling_near")
    ends = roots(near.where(F.col("form").isNotNull()).select("word", "form"))
    discard(words)
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
