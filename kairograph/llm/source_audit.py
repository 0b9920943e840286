"""Audit of how the sources of a language differ in their vocabulary.

All of it is relational: terms are exploded and counted, each group of a
language and a source is crossed with its language's kept terms so that
absent terms count zero, and a self-join on language and term compares the
groups, whose differences are summed and ranked. Numbers are whole: shares
are parts of a thousand million and all divisions are integer divisions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, staged

#: What parts terms, which are maximal runs of ASCII letters and of signs beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 10
#: Terms that are reported for a group.
TOP = 10
#: Parts of one.
PARTS = 1_000_000_000
#: The terms of a language are crossed with its groups in so many parts, so that one language may hold most rows.
SALTS = 64


def lowered(text: Column) -> Column:
    """``text`` with only A-Z in lower case; of texts in ASCII that is what ``lower`` does, far faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def numbered_groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """``lang, source, lid, gid`` of the groups that occur, and the seed of the hashes that number them: one for which all differ."""
    groups = staged(rows.select("lang", "source").distinct(), "audit_groups")
    n, langs = groups.agg(F.count(F.lit(1)), F.count_distinct("lang")).first()
    seed = 0
    while True:
        found = groups.withColumns(_numbers(seed))
        if tuple(found.agg(F.count_distinct("gid"), F.count_distinct("lid")).first()) == (n, langs):
            return found, seed
        seed += 1


def _numbers(seed: int) -> dict[str, Column]:
    return {"gid": F.xxhash64("lang", "source", F.lit(seed)), "lid": F.xxhash64("lang", F.lit(seed))}


def term_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``term, gid, lid, n, docs``: occurrences, and documents that hold the term, from ``lang, source, text`` without nulls.

    A document's terms and its distinct terms are exploded together, so that the texts are read and cut once. They
    are split at what parts them, since Java's engine tests that class ten times as fast as its complement.
    Groups go by number, which is less to hash and to move than two texts.
    """
    numbers = _numbers(seed)
    cut = docs.select(numbers["gid"].alias("gid"), numbers["lid"].alias("lid"), F.array_remove(F.split(lowered(F.col("text")), BETWEEN), "").alias("terms"))
    rows = cut.select("gid", "lid", F.size("terms").alias("all"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    first = (F.col("at") < F.col("all")).cast("int")
    return rows.groupBy("term", "gid", "lid").agg(F.sum(first).alias("n"), F.sum(1 - first).alias("docs"))


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * kept)), exact."""
    wide = lambda x: x.cast("decimal(20,0)")
    top = (wide(F.col(count)) + wide(F.lit(2))) * F.lit(PARTS).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, wide(F.col(total) + 2 * F.col(kept)))


def _difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exact: shares are below 2^31, so that squares fit."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of a language and a source.

    Part ``pair`` has the other sources of the language by how far their shares differ, summed over all kept terms
    (0 where the language keeps none). Part ``term`` has the ``top`` terms that the group holds more often, by share,
    than its language. Ranks follow value, descending, then the item's UTF-8 bytes.

    Null text, language and source read as the empty string; a row is a document, also where keys repeat or rows are
    equal. Other columns, whatever their names, aren't read. Without rows the result is empty; a language with one
    source has no pairs.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"), F.coalesce(text, empty).alias("text"))
    groups, seed = numbered_groups(rows)
    counts = staged(term_counts(rows, seed), "audit_counts")
    terms = counts.groupBy("term", "lid").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = staged(terms.select("term", "lid", "n"), "audit_terms")
    langs = terms.groupBy("lid").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total"))

    # each language's terms with each of its groups; keys are terms first, which sort fast, and never held by one task
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")
    spread = groups.select("lid", "gid", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dense = terms.select("term", "lid", salt).join(spread, ["lid", "salt"]).drop("salt")
    dense = dense.join(counts.select("term", "gid", "n").hint("shuffle_hash"), ["term", "gid"], "left").fillna(0, ["n"])
    dense = staged(dense, "audit_dense")
    totals = dense.groupBy("gid").agg(F.sum("n").alias("total"))
    sizes = groups.join(langs.drop("total"), "lid").join(totals, "gid").select("gid", "kept", "total")
    shares = staged(dense.join(sizes, "gid").select("term", "lid", "gid", "n", _share("n", "total", "kept").alias("p")), "audit_shares")

    other = shares.select("term", "lid", F.col("gid").alias("other"), F.col("p").alias("q"))
    sums = shares.select("term", "lid", "gid", "p").join(other.hint("shuffle_hash"), ["term", "lid"]).where(F.col("gid") < F.col("other"))
    sums = sums.groupBy("gid", "other").agg(F.sum(_difference(F.col("p"), F.col("q"))).alias("value"))
    sides = F.explode(F.array(F.struct("gid", "other"), F.struct(F.col("other").alias("gid"), F.col("gid").alias("other")))).alias("x")
    sums = sums.select(sides, "value").select("x.*", "value")
    item = groups.select("lid", F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = groups.join(item, "lid").where(F.col("gid") != F.col("other"))
    pairs = pairs.join(sums, ["gid", "other"], "left").fillna(0, ["value"])

    whole = terms.join(langs, "lid").select("term", "lid", _share("n", "total", "kept").alias("q"))
    over = shares.where("n > 0").join(whole, ["term", "lid"]).where(F.col("p") > F.col("q"))
    over = over.select("gid", F.col("term").alias("item"), _difference(F.col("p"), F.col("q")).alias("value"))
    near = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    over = over.withColumn("at", F.row_number().over(near)).where(F.col("at") <= top).join(groups, "gid")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    result = out(pairs, "pair").unionByName(out(over, "term"))
    discard(counts, dense)
    return result


#: DuckDB SQL of ``audit`` over ``documents``.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
w AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS p FROM (SELECT lang, source, term, n, w.total, v FROM w JOIN l USING (lang))),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS q FROM k JOIN l USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
over_ AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM s JOIN q USING (lang, term) WHERE s.n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM over_))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
