import collections
import random
import re

import pytest

from kairograph.llm import source_audit

DOCS = "doc_id long, text string, lang string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=10):
    """The audit in plain loops over ``(lang, source, text)``."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        held = collections.Counter(t for la, _, ts in found if la == lang for t in set(ts))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: collections.Counter() for la, s, _ in found if la == lang}
        for la, s, ts in found:
            if la == lang:
                counts[s].update(t for t in ts if t in set(kept))
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), collections.Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_audit_equals_plain_loops(spark, seed):
    draw = random.Random(seed)
    terms = ["Straße", "été", "ÉTÉ", "Wort", "wort", "ﬁ", "İx", "數據", "a_b", "x1y", "🙂", "end"]
    rows = [(draw.choice(["de", "fr", None, ""]), draw.choice(["s1", "s2", "é", None, "z"]), " ".join(draw.choices(terms, weights=range(1, 13), k=draw.randrange(30)))) for _ in range(120)]
    rows += [("fr", "only", None), ("xx", "lone", "few words"), ("xx", "other", "")]
    docs = spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], DOCS)
    got = {tuple(r) for r in source_audit.audit(docs).collect()}
    assert got == plain(rows)
    assert any(r[2] == "term" for r in got) and ("xx", "lone", "pair", "other", 0, 1) in got


def test_audit_of_repeats_ties_clashes_and_nothing(spark):
    rows = [("en", s, "same words here") for s in ("b", "a", "c")] * 5
    docs = spark.createDataFrame([(1, t, lang, s, "x", 2) for lang, s, t in rows], DOCS + ", term string, value int")
    got = source_audit.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plain(rows)
    assert source_audit.audit(docs.where("false")).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    n, total, kept = 9_000_000_000_000_000, 9_100_000_000_000_003, 12_345_678
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(source_audit._share("n", "total", "kept")).first()[0]
    assert row == 1 + 1_000_000_000 * (n + 2) // (total + 2 * kept)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(i, "word " * 200_000 if i < 10 else "word", "en", f"s{i % 2}") for i in range(12)], DOCS)
    got = {tuple(r) for r in source_audit.audit(docs).collect()}
    assert got == plain([("en", f"s{i % 2}", "word " * 200_000 if i < 10 else "word") for i in range(12)])
