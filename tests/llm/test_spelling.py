import collections
import random
import re
import zlib

import numpy as np
import pytest

from kairograph.llm import spelling

DOCS = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(x, y):
    """Exactly one inserted, deleted or replaced code point."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_words(rows):
    count = collections.Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain(rows):
    words = plain_words(rows)
    forms, out = {}, {}
    for w, n in words.items():
        beside = [y for y in words if near(w, y)]
        best = min(beside, key=lambda y: (-words[y], y), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out[w] = len(beside)
    result = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        result.add((w, forms[w], root, n, out[w], words.get(forms[w])))
    return result


def texts(draw, docs, stems=8):
    """Documents of few stems, many of them edited once, with frequencies that differ by powers."""
    alphabet = "abcÀéÿxyzAB÷"
    stem = ["".join(draw.choices(alphabet, k=draw.randrange(6, 12))) for _ in range(stems)]

    def edited(w):
        at, kind = draw.randrange(len(w) + 1), draw.randrange(4)
        return w[:at] + draw.choice(alphabet) + w[at:] if kind == 0 else w[: max(0, at - 1)] + w[at:] if kind == 1 else w[:at] + draw.choice(alphabet) + w[at + 1 :]

    variants = [edited(draw.choice(stem)) for _ in range(40)]
    variants += [edited(v) for v in variants]
    pick = lambda: draw.choices(stem, weights=[2.0**-i for i in range(stems)])[0] if draw.random() < 0.9 else draw.choice(variants)
    return [" ".join(pick() for _ in range(60)) for _ in range(docs)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_variants_equal_plain_loops(spark, seed):
    draw = random.Random(seed)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts(draw, 150))]
    want = plain(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert {tuple(r) for r in spelling.group_variants(docs).collect()} == want
    assert any(r[1] for r in want) and any(r[4] > 5 for r in want)


def test_roots_follow_chains_of_forms(spark):
    chain = [("a" * (7 + i), 2 * 10**i) for i in range(6)]
    words = spark.createDataFrame(chain, "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.neighbours(words).collect()}
    assert got == {w: (1 if i in (0, 5) else 2, chain[min(i + 1, 5) - (i == 5)][0], chain[min(i + 1, 5) - (i == 5)][1]) for i, (w, _) in enumerate(chain)}
    forms = spark.createDataFrame([(a[0], b[0]) for a, b in zip(chain, chain[1:])], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {w: chain[-1][0] for w, _ in chain[:-1]}


def test_crowded_shards_are_dealt_into_blocks(spark):
    draw = random.Random(5)
    rows = list(enumerate(texts(draw, 150)))
    docs = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in spelling.group_variants(docs, size=7).collect()} == plain(rows)
    words = spark.createDataFrame([(f"abc{i:04d}xyz".translate(str.maketrans("0123456789", "abcdefghij")), 2) for i in range(500)], "word string, n long")
    sizes = spelling.dealt(words, 50).groupBy("side", "shard", "i", "j").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 200


def test_verification_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 40)
    draw = random.Random(3)
    words = sorted({"".join(draw.choices("ab", k=draw.randrange(7, 10))) for _ in range(300)})
    count = [draw.randrange(2, 50) for _ in words]
    total = np.zeros(len(words), dtype=int)
    best = [[] for _ in words]
    for side in (0, 1):
        shard = spelling.Shard(side, words, count)
        n, first = shard.near(words)
        total += n
        for i, y in enumerate(first.tolist()):
            if y >= 0:
                best[i].append((-shard.counts[y], shard.words[y]))
    for i, w in enumerate(words):
        beside = [(-c, y) for y, c in zip(words, count) if near(w, y)]
        assert total[i] == len(beside) and min(best[i], default=None) == min(beside, default=None)


def test_same_length_counts_do_not_wrap():
    x = np.zeros((1, 600), dtype=np.uint8)
    y = np.ones((1, 600), dtype=np.uint8)
    y[0, :87] = 0
    assert not spelling.one_edit(x, y)[0, 0]
    y[:] = 0
    y[0, 5] = 1
    assert spelling.one_edit(x, y)[0, 0]


def test_odd_rows(spark):
    long = "q" * 50_000
    rows = [(1, None), (2, ""), (3, "short words only"), (4, "Straßen straßen STRASSEN strassen"), (4, "Straßen straßen STRASSEN strassen"), (None, f"{long} {long}"), (6, f"{long}q"), (7, f"{long}q"), (8, "été×été÷ÀÀ été×été÷ÀÀ 🙂abcdefgh🙂abcdefgh")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", word string, n int")
    got = spelling.group_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain(rows)
    assert spelling.group_variants(docs.where("false")).collect() == []
