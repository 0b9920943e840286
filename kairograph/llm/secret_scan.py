"""Secret scan over a trigram inverted index, in DataFrame operations only.

(After Cox, "Regular expression matching with a trigram index", 2012.) Each
rule's regular expression gives a Boolean query: an OR of clauses, each an AND
of trigrams that any match must contain, lower-cased. The index maps every
trigram that some query names to postings, which are 64-bit hashes of whole
texts, in shards of bounded size. Posting lists are intersected per clause and
shard. A rule that has a clause without trigrams has no such query and scans
every text. Hashes that collide only add candidates: each candidate is
verified by the rule itself.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: group whose length must be at least ``least``
    group: int = 0
    least: int = 0


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Rules repeat single signs only: Java's engine walks repeated groups by recursion, and a long match would overflow its stack. Runs that
#: a rule reads to their end are read once: a match that fails there doesn't begin again within them.
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # AKIA[A-Z0-9]+ of 20 or more: runs are maximal, so that a minimum drops the same ones
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES
#: Rows that one shard of a posting list may come from.
SHARD_ROWS = 50_000
#: Candidates (16 bytes each) up to which their table is broadcast.
BROADCAST_ROWS = 500_000
_MOST = 64  # alternatives that a derivation keeps apart


def _walk(nodes, states: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
    """Extend each state (literals that are complete, the literal being read) by a sequence of nodes."""

    def close(xs):
        return {(done | {run} if len(run) > 2 else done, "") for done, run in xs}

    for op, arg in nodes:
        if op is sre.LITERAL:
            states = {(done, run + chr(arg).lower()) for done, run in states}
        elif op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(states) * len(arg) <= _MOST:
            states = {(done, run + chr(c).lower()) for done, run in states for _, c in arg}
        elif op is sre.SUBPATTERN:
            states = _walk(arg[-1], states)
        elif op is sre.BRANCH:
            states = set().union(*(_walk(x, states) for x in arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            if low == 0 and high == 1:
                states = states | _walk(sub, states)
            else:
                for _ in range(min(low, 4)):
                    states = _walk(sub, states)
                states = states if low == high <= 4 else close(states)
        elif op is not sre.AT:
            states = close(states)
        if len(states) > _MOST:
            states = close(states)
    return states


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of lower-cased trigrams that every match contains, or None if some match needs none."""
    clauses = set()
    for done, run in _walk(sre_parser.parse(pattern), {(frozenset(), "")}):
        clauses.add(frozenset(x[i : i + 3] for x in (*done, run) for i in range(len(x) - 2)))
    if frozenset() in clauses:
        return None
    return sorted(sorted(c) for c in clauses if not any(o < c for o in clauses))


def build_index(texts: DataFrame, trigrams: list[str], shards: int) -> DataFrame:
    """Postings ``(trigram, shard, postings)`` of rows ``(h, low)``: hash and lower-cased text."""
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return (
        texts.select("h", F.explode(found).alias("trigram"))
        .groupBy("trigram", F.pmod("h", F.lit(shards)).alias("shard"))
        .agg(F.collect_set("h").alias("postings"))
    )


def candidates(index: DataFrame, asked: dict[str, list[list[str]]]) -> DataFrame:
    """``(h, rules)``: the texts that satisfy the Boolean queries of ``asked``, with those rules."""
    rows = [(kind, i, t, len(c)) for kind, clauses in asked.items() for i, c in enumerate(clauses) for t in c]
    clauses = index.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    return (
        index.join(F.broadcast(clauses), "trigram")  # a row per trigram of the rules
        .groupBy("kind", "clause", "shard", "need").agg(F.collect_list("postings").alias("lists"))
        .where(F.size("lists") == F.col("need"))
        .select("kind", F.explode(F.aggregate(F.slice("lists", 2, 1 << 20), F.element_at("lists", 1), F.array_intersect)).alias("h"))
        .groupBy("h").agg(F.collect_set("kind").alias("rules"))
    )


def _steps(matches: Column, gaps: Column) -> Column:
    """For each match the lengths of the text before it, since the last match, and of itself, and the match."""
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"))
    return F.transform(pairs, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["m"].alias("m")))


def _spans(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rid, spans`` of rows ``rid, steps`` (the steps of each rule): ends are running sums over a text's matches."""
    each = found.select("rid", F.posexplode("steps").alias("rule", "steps")).where(F.size("steps") > 0)
    each = each.select("rid", "rule", F.posexplode("steps").alias("at", "x")).select("rid", "rule", "at", "x.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    each = each.withColumn("end", end)
    for i, r in enumerate(rules):
        if r.least:
            each = each.where((F.col("rule") != i) | (F.length(F.regexp_extract("m", r.pattern, r.group)) >= r.least))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "end", kind.alias("kind"))
    return each.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # of one text


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, found``: for every row the spans ``array<struct<start, end, kind, rule>>``, by start and then by rule.

    Spans of a rule are its leftmost non-overlapping matches in code points,
    end exclusive, without those whose group is too short. Null and empty
    texts have none. Rows with null or repeated keys keep a row each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("h"))
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if asked:
        shards = max(1, -(-docs.count() // SHARD_ROWS))
        trigrams = sorted({t for q in asked.values() for c in q for t in c})
        index = staged(build_index(rows.select("h", F.lower("text").alias("low")), trigrams, shards), "trigram_index")
        hits = staged(candidates(index, asked), "trigram_hits")
        small = hits.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(hits) if small else hits.hint("shuffle_hash"), "h", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    for r in rules:
        wanted = F.array_contains("rules", r.kind) if r.kind in asked else F.lit(True)
        rows = rows.withColumn(f"m_{r.kind}", F.when(wanted, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))))
    steps = []
    for r in rules:
        some = F.size(f"m_{r.kind}") > 0
        steps.append(F.when(some, _steps(F.col(f"m_{r.kind}"), F.split("text", r.pattern, -1))))
    scanned = staged(rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.array(*steps).alias("steps")), "secret_steps")
    spans = _spans(scanned.where(F.exists("steps", lambda x: F.size(x) > 0)).select("rid", "steps"), rules)
    none = F.expr("cast(array() as array<struct<start: int, rule: int, end: int, kind: string>>)")
    return scanned.select("doc_id", "rid").join(spans, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and texts of the spans, as the query returns them."""
    base = [r.kind for r in BASE_RULES]
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(said(F.filter("found", lambda x: x["rule"] < len(base))), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    )
