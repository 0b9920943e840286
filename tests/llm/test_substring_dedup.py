import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.llm import substring_dedup

DOCS = "doc_id long, text string"
W = substring_dedup.WINDOW


def plain(rows):
    """For each row the words and which of them go."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (key, _), ws in zip(rows, words):
        for i in range(len(ws) - W + 1):
            if key is not None:
                s = tuple(ws[i : i + W])
                first[s] = min(key, first.get(s, key))
    out = []
    for (key, _), ws in zip(rows, words):
        gone = np.zeros(len(ws), dtype=bool)
        for i in range(len(ws) - W + 1):
            if key is not None and first[tuple(ws[i : i + W])] < key:
                gone[i : i + W] = True
        out.append((key, len(ws), int(gone.sum()), " ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=str)


def got(frame):
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return sorted(((r[0], r[1], r[2], r[3] or "") for r in frame.select("doc_id", "n_words", gone, "text").collect()), key=str)


def corpus(draw, n=60, size=30):
    """Texts of few words with passages copied from one another: whole, cut, edited, in other blanks."""
    fresh = lambda k: [f"w{draw.randrange(size)}" for _ in range(k)]
    texts = [fresh(draw.randrange(40, 300)) for _ in range(n // 3)]
    while len(texts) < n:
        old = draw.choice(texts)
        a = draw.randrange(len(old))
        part = old[a : a + draw.choice([30, 49, 50, 51, 52, 80, 120, 400])]
        if draw.random() < 0.3 and part:
            part = list(part)
            part[draw.randrange(len(part))] = "edit"
        texts.append(fresh(draw.randrange(0, 60)) + part + fresh(draw.randrange(0, 60)))
    draw.shuffle(texts)
    return [draw.choice([" ", "\n", "\t ", "\v"]).join(t) for t in texts]


@pytest.mark.parametrize(("seed", "group"), [(0, 20_000), (1, 20_000), (2, 3), (3, 1)])
def test_passages_equal_plain_windows(spark, seed, group):
    """Small groups are split by longer prefixes, down to whole windows."""
    rows = list(enumerate(corpus(random.Random(seed))))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = plain(rows)
    assert sum(r[2] for r in want) > 500
    assert got(substring_dedup.remove_passages(docs, group=group)) == want


def test_one_passage_in_all_texts(spark):
    draw = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join(f"{draw.random()}" for _ in range(20)) + " " + passage + " " + " ".join(f"{draw.random()}" for _ in range(20))) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    want = plain(rows)
    assert [r[2] for r in want].count(55) == 39
    for group in (20_000, 5):
        assert got(substring_dedup.remove_passages(docs, group=group)) == want


def test_long_texts_are_gone_through_in_pieces(spark, monkeypatch):
    draw = random.Random(11)
    long = " ".join(f"w{draw.randrange(50)}" for _ in range(3000)) + " " + "x" * 4000 + " " + " ".join(f"w{draw.randrange(50)}" for _ in range(2000))
    data = substring_dedup.normal(long.encode())
    words = data.split()
    for size in (300, 1000, 5000, 1 << 18):
        seen = set()
        for number, piece in substring_dedup.pieces(data, size):
            part = piece.split()
            assert words[number : number + len(part)] == part
            seen.update(range(number, number + len(part) - W + 1))
        assert seen == set(range(len(words) - W + 1))
    rows = [(1, long), (2, "one more word " + long), (3, long[2000:9000]), (4, "say " * 3000), (5, "say " * 2000), (6, "say it " * 100)]
    docs = spark.createDataFrame(rows, DOCS)
    want = plain(rows)
    assert got(substring_dedup.remove_passages(docs)) == want
    for block in (64, 700):
        n = {p for p in (8, 24, 50) for b in [list(substring_dedup.pieces(data, block))] if sum((lambda r: int((r[3] - r[2] + 1).sum()))(substring_dedup.sampled(piece, p)) for _, piece in b) == len(words) - W + 1}
        assert n == {8, 24, 50}


def test_odd_rows(spark):
    same = " ".join(f"été{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, same), (4, same), (None, same), (9, same), (9, same + " more"), (7, "y" * 100_000), (8, " ".join("z" for _ in range(49)))]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], DOCS + ", removed string, n_words int").withColumn("other.name", F.lit(1))
    out = substring_dedup.remove_passages(docs)
    assert out.columns == ["doc_id", "text", "other.name", "n_words", "removed"]
    assert got(out) == plain(rows)
    assert out.where("text is null").count() == 1
    assert substring_dedup.remove_passages(docs.where("false")).collect() == []
