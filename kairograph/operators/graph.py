"""The property graph as two tables: upsert, relation resolution, as-of views, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_uuid(group: Column, label: Column, key: Column) -> Column:
    """The same node has the same identifier in every run."""
    return F.sha2(F.concat_ws("|", group, label, key), 256)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All nodes with ``status`` created, reused or kept; MERGE as one outer join, duplicates of a batch being one node."""
    new = incoming.select(*keys).distinct().withColumn("n", F.lit(True))
    old = existing.select(*keys).distinct().withColumn("o", F.lit(True))
    status = F.when(F.col("n") & F.col("o"), "reused").when(F.col("n"), "created").otherwise("kept")
    return old.join(new, keys, "full_outer").select(*keys, status.alias("status"))


def resolve(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations ``source_key, target_key, ...`` whose ends are both among the entities ``key, uuid``.

    Of entities that share a key the last one counts, by ``pos`` if there is such a column, else by uuid.
    """
    ends = entities.groupBy("key").agg(F.max_by("uuid", "pos" if "pos" in entities.columns else "uuid").alias("uuid"))
    source = ends.select(F.col("key").alias("source_key"), F.col("uuid").alias("source_uuid"))
    target = ends.select(F.col("key").alias("target_key"), F.col("uuid").alias("target_uuid"))
    return relations.join(source, "source_key").join(target, "target_key")


def unresolved(relations: DataFrame, entities: DataFrame) -> DataFrame:
    keys = entities.select("key").distinct()
    kept = relations.join(keys.withColumnRenamed("key", "source_key"), "source_key", "left_semi").join(keys.withColumnRenamed("key", "target_key"), "target_key", "left_semi")
    return relations.join(kept.select("source_key", "target_key").distinct(), ["source_key", "target_key"], "left_anti")


def with_expiry(facts: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """``expired_at``: when the next fact of the same key supersedes this one, null while it holds."""
    return facts.withColumn("expired_at", F.lead(at).over(Window.partitionBy(*by).orderBy(at, tie)))


def as_of(facts: DataFrame, when, at: str = "valid_at", *, strict_expired: bool = False) -> DataFrame:
    """Facts that hold at ``when``: half-open intervals, null being open (or, if strict, not at all)."""
    when = F.lit(when) if not isinstance(when, Column) else when
    later = F.col("expired_at") > when
    return facts.where((F.col(at) <= when) & (later if strict_expired else F.col("expired_at").isNull() | later))


def as_of_many(facts: DataFrame, dates: DataFrame, *, low: str = "valid_at", high: str = "expired_at", at: str = "as_of", unit: int = 86400, levels: int = 17) -> DataFrame:
    """Each date of ``dates`` with the facts that hold at it, half-open intervals, null being open: all columns of both.

    Time is cut into bins of ``unit`` seconds, two of which make a bin of the next level. An interval is the sum of at most two
    bins a level, and a date lies in one a level, so that both meet by an equi-join on bins, however long
    intervals are; the exact bounds decide in the bins that they cut. Dates and bounds lie within 2 ** levels
    units around 1970. A null date is in no interval.
    """
    half = 1 << (levels - 1)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    bin_ = lambda c, up: F.when(F.col(c).isNotNull(), F.least(F.greatest((F.ceil if up else F.floor)(seconds(c) / unit) + half, F.lit(0)), F.lit(2 * half))).cast("long")
    first, last = F.coalesce(bin_(low, False), F.lit(0).cast("long")), F.coalesce(bin_(high, True), F.lit(2 * half).cast("long"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k"))
    spread = facts.withColumns({"__first": first, "__last": last}).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    spread = spread.withColumns({"__l": F.ceil(F.col("__first") / size).cast("long"), "__r": F.floor(F.col("__last") / size).cast("long")}).where("__l < __r")
    odd = lambda c: F.col(c) % 2 == 1
    ends = F.array_compact(F.array(F.when(odd("__l"), F.col("__l")), F.when(odd("__r"), F.col("__r") - 1)))
    spread = spread.withColumn("__bin", F.explode(F.array_distinct(ends))).drop("__first", "__last", "__l", "__r")
    own = dates.where(F.col(at).isNotNull()).withColumn("__at", bin_(at, False)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    own = own.withColumn("__bin", F.floor(F.col("__at") / size).cast("long")).drop("__at")
    holds = (F.col(low).isNull() | (F.col(low).cast("timestamp") <= F.col(at).cast("timestamp"))) & (F.col(high).isNull() | (F.col(high).cast("timestamp") > F.col(at).cast("timestamp")))
    return own.join(spread, ["__k", "__bin"]).where(holds).drop("__k", "__bin")


def candidates(edges: DataFrame) -> DataFrame:
    """Edges as a search returns them: ``uuid, fact, edge_name, valid_at, invalid_at``."""
    return edges.select("uuid", "fact", F.col("name").alias("edge_name"), "valid_at", "invalid_at")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``node, depth``: nodes within ``depth`` steps of the seeds over undirected ``a, b``, at their least depth.

    Each step carries the least depth of every node reached on to its
    neighbours and combines it with what was known: the plan grows by one join a step and
    never holds paths.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = seeds.select("node", F.lit(0).alias("depth")).distinct()
    for _ in range(depth):
        # a row for the node itself and one for each neighbour, from one pass over ``known``
        reach = known.join(both, known["node"] == both["a"], "left").select("node", "depth", F.col("b"))
        steps = F.array(F.struct("node", "depth"), F.struct(F.col("b").alias("node"), (F.col("depth") + 1).alias("depth")))
        known = reach.select(F.inline(steps)).where("node is not null").groupBy("node").agg(F.min("depth").alias("depth"))
    return known
