"""Personal data by fixed kinds and bootstrapped contextual extraction.

Spans of the fixed kinds are the seeds. A pattern is the two words before a
span; an instance is what stands there: a seed, or another identifier-like
token. In each round, patterns with enough distinct known instances, and mostly
followed by identifiers wherever they occur in the corpus, are scored on the
graph of patterns and instances: a pattern by the share of its instances
believed to be of the kind, where a seed counts one and any other instance what
the *other* patterns that extract it say, so that no pattern vouches for itself.
Instances of patterns of high confidence become known, and let further patterns
be induced in the next round. In the end the patterns accepted in any round add
the other tokens that they extract to the spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern needs, and the least confidence of patterns and added instances.
SUPPORT, CONFIDENCE = 5, 0.8
#: Least share of a pattern's occurrences that an identifier follows.
FOLLOWED = 0.5
#: Rounds of bootstrapping at most (it ends when a round accepts no new pattern), and turns of scoring in each.
ROUNDS, TURNS = 4, 3
#: Patterns (some 30 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 100_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Leftmost matches start where a run of digits does: after a match there is no digit left of its run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"(?<![A-Za-z0-9@._+/-])[A-Za-z._+/-]*+[0-9@][A-Za-z0-9@._+/-]*+")  # whole runs with a digit or an @: others aren't seen in Python
_START = re.compile(r"(?<![\w@.+-])[A-Za-z0-9]")  # of a token within a run
_INNER = "@._+/-"  # signs that end no token
_FOLD = bytes.maketrans(b"123456789", b"000000000")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the local part is the whole run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = after = m.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed kinds, in code points."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def context(text: str, start: int) -> str:
    """The two words before a place, A-Z lower-cased and digits as 0; fewer words at the start: what there is."""
    before = text[max(0, start - 80) : start].encode().lower().translate(_FOLD)
    return b" ".join(before.split()[-2:]).decode(errors="ignore")


def other_tokens(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens (6 characters with 4 digits or an @ inside) that overlap no base span.

    A run of such signs has one token at most: from the first place where one may start to the last letter or digit.
    """
    ends = sorted((a, b) for a, _, b in taken)
    i = 0
    for m in _RUN.finditer(text):
        start = _START.search(text, m.start(), m.end())
        if not start:
            continue
        token = text[start.start() : m.end()].rstrip(_INNER)
        if len(token) < 6 or not ("@" in token or sum("0" <= c <= "9" for c in token) >= 4):
            continue
        low, high = start.start(), start.start() + len(token)
        while i < len(ends) and ends[i][1] <= low:
            i += 1
        if i == len(ends) or ends[i][0] >= high:
            yield low, high


_MARKS = "array<struct<start: int, k: int, end: int, pattern: string, instance: string>>"
_FOUR_DIGITS = re.compile(r"[0-9][^\s]*[0-9][^\s]*[0-9][^\s]*[0-9]")


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        marks = []
        for text in batch["text"]:
            found = base_spans(text)
            here = [{"start": a, "k": k, "end": b, "pattern": context(text, a), "instance": text[a:b].lower()} for a, k, b in found]
            here += [{"start": a, "k": -1, "end": b, "pattern": context(text, a), "instance": text[a:b].lower()} for a, b in other_tokens(text, found)]
            marks.append(here)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "marks": marks})


def pattern_background(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: occurrences of each pattern of two words in the whole corpus, whatever follows."""
    spark = texts.sparkSession
    size = patterns.count()
    if not size:
        return patterns.withColumn("total", F.lit(0).cast("long"))
    small = size <= BROADCAST_ROWS
    shared = spark.sparkContext.broadcast(frozenset(r["pattern"].encode() for r in patterns.collect()) if small else None)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        last = None if asked is None else {p.rpartition(b" ")[2] for p in asked}
        kept: Counter = Counter()
        for batch in batches:
            for data in batch["data"]:
                words = data.lower().translate(_FOLD).split()
                for a, b in zip([b"", *words], words, strict=False):
                    if last is None or b in last:
                        p = a + b" " + b
                        if asked is None or p in asked:
                            kept[p] += 1
                if len(kept) > 300_000:
                    yield pd.DataFrame({"pattern": [p.decode(errors="ignore") for p in kept], "n": list(kept.values())})
                    kept.clear()
        if kept:
            yield pd.DataFrame({"pattern": [p.decode(errors="ignore") for p in kept], "n": list(kept.values())})

    counts = texts.mapInPandas(count, "pattern string, n long")
    if not small:
        counts = counts.join(patterns, "pattern", "left_semi")
    return counts.groupBy("pattern").agg(F.sum("n").alias("total"))


def scored(links: DataFrame, turns: int = TURNS) -> DataFrame:
    """``pattern, k, score`` of the patterns in ``links`` (``pattern, k, instance, known, size``; one row for each pattern, kind and instance).

    ``known`` is the belief in known instances, null for others; ``size`` the pattern's distinct
    instances. Other instances get 1 - the product of (1 - score) over the other patterns of the kind.
    """
    doubt = lambda c: F.log(F.greatest(F.lit(1e-9), 1 - F.col(c)))
    sure = F.sum("known") / F.col("size")
    now = links.groupBy("pattern", "k", "size").agg(sure.alias("score"))
    shared = links.where("known is null").groupBy("instance", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("instance", "k")
    shared = staged(links.join(shared, ["instance", "k"], "left_semi").where("known is null").select("pattern", "k", "instance"), "pii_shared")
    base = now = staged(now, "pii_scores")
    for _ in range(turns if not shared.isEmpty() else 0):
        each = shared.join(F.broadcast(now) if now.count() <= BROADCAST_ROWS else now, ["pattern", "k"])
        all_ = each.groupBy("instance", "k").agg(F.sum(doubt("score")).alias("all"))
        others = each.join(all_, ["instance", "k"]).groupBy("pattern", "k").agg(F.sum(1 - F.exp(F.least(F.lit(0.0), F.col("all") - doubt("score")))).alias("more"))
        before = now
        now = base.join(others, ["pattern", "k"], "left").select("pattern", "k", "size", (F.col("score") + F.coalesce("more", F.lit(0.0)) / F.col("size")).alias("score"))
        now = staged(now, "pii_scores")
        if before is not base:
            discard(before)
    return now.select("pattern", "k", "score")


def learn_patterns(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """``pattern, k, score`` of the accepted patterns, from rows with ``marks`` and the corpus' texts (``data``)."""
    seen = marked.select(F.inline("marks")).groupBy("pattern", "instance", "k").agg(F.count(F.lit(1)).alias("n"))
    seen = staged(seen.where(F.col("pattern") != ""), "pii_graph")
    sizes = seen.groupBy("pattern").agg(F.count_distinct("instance").alias("size"), F.sum("n").alias("followed")).where(F.col("size") >= SUPPORT)
    sizes = staged(sizes, "pii_patterns")
    total = pattern_background(texts, sizes.select("pattern"))
    fit = sizes.join(total, "pattern", "left").where(F.col("followed") >= FOLLOWED * F.greatest("followed", F.coalesce("total", F.lit(0)))).select("pattern", "size")
    graph = staged(seen.select("pattern", "instance").distinct().join(fit, "pattern"), "pii_links")
    known = staged(seen.where("k >= 0").select("instance", "k").distinct().withColumn("belief", F.lit(1.0)), "pii_known")
    accepted = known.select(F.lit("").alias("pattern"), "k", F.col("belief").alias("score")).where("false")
    for _ in range(ROUNDS):
        support = graph.join(known, "instance").groupBy("pattern", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("belief").alias("sum"), F.first("size").alias("size"))
        able = support.where((F.col("n") >= SUPPORT) & (F.col("sum") >= CONFIDENCE / 2 * F.col("size"))).select("pattern", "k")
        able = staged(able.join(accepted.select("pattern", "k"), ["pattern", "k"], "left_anti"), "pii_able")
        if able.isEmpty():
            break
        tried = staged(able.unionByName(accepted.select("pattern", "k")), "pii_tried")
        links = graph.join(tried, "pattern").join(known, ["instance", "k"], "left").select("pattern", "k", "instance", F.col("belief").alias("known"), "size")
        links = staged(links, "pii_round")
        new = scored(links).join(accepted.select("pattern", "k"), ["pattern", "k"], "left_anti").where(F.col("score") >= CONFIDENCE)
        new = staged(new, "pii_new")
        if new.isEmpty():
            break
        found = links.where("known is null").join(new, ["pattern", "k"]).groupBy("instance", "k").agg(F.max("score").alias("belief"))
        known = staged(known.unionByName(found), "pii_known")
        accepted = staged(accepted.unionByName(new), "pii_accepted")
        discard(links, tried, able)
    return accepted


def find_personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, found``: the spans ``array<struct<start, k, end, added>>`` of every row, by start and then kind.

    Null and empty texts have none. Rows with null or repeated keys keep a row
    each. A token that patterns of several kinds extract gets the best-scored kind.
    """
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = staged(rows.mapInPandas(_mark, f"doc_id string, marks {_MARKS}").withColumn("rid", F.monotonically_increasing_id()), "pii_marks")
    accepted = learn_patterns(marked, docs.select(text_bytes(text).alias("data")))
    best = accepted.groupBy("pattern").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("kind"))
    base = F.transform(F.filter("marks", lambda x: x["k"] >= 0), lambda x: F.struct(x["start"], x["k"], x["end"], F.lit(False).alias("added")))
    out = marked.select("rid", F.col("doc_id").cast("long").alias("doc_id"), base.alias("base"))
    more = (
        marked.select("rid", F.inline(F.filter("marks", lambda x: x["k"] < 0))).join(best, "pattern")
        .groupBy("rid").agg(F.collect_list(F.struct("start", F.col("kind").alias("k"), "end", F.lit(True).alias("added"))).alias("more"))  # of one text
    )
    none = F.expr("cast(array() as array<struct<start: int, k: int, end: int, added: boolean>>)")
    return out.join(more, "rid", "left").select("doc_id", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans and the texts of the spans, as the query returns them."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: ~x["added"])
    count = lambda n: F.size(F.filter(base, lambda x: x["k"] == n)).cast("long")
    return found.select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"),
    )
