"""Writing the graph and the episodes: deltas, counters, dry runs.

Nodes and edges of a batch are one transaction of a log of deltas (``deltas``), so that a
batch writes in proportion to itself, readers never see nodes without their edges, and
writers lose nothing of one another. Episodes and the ledger are partitioned by batch: a
batch that is done again overwrites its own partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.operators import deltas, graph, ledger

GROUP = "default"
NODES = "uuid string, type string, key string, name string, summary string, attrs string, source_ref string, group_id string"
EDGES = "uuid string, source_uuid string, target_uuid string, name string, fact string, valid_at timestamp, invalid_at timestamp, source_ref string, group_id string"
EPISODES = "episode_key string, content_hash string, name string, body string, source_description string, reference_time timestamp, kind string, group_id string, batch string"
LEDGER = "episode_key string, content_hash string, ingested_at timestamp, batch string"


def nodes_of(extractions: DataFrame, group: str = GROUP) -> DataFrame:
    """A row per entity of rows ``source_ref, entities``: NODES and ``pos``, its place in the list."""
    each = extractions.select("source_ref", F.posexplode("entities").alias("pos", "e")).select("source_ref", "pos", "e.*")
    return each.select(graph.node_uuid(F.lit(group), F.col("type"), F.col("key")).alias("uuid"), "type", "key", "name", "summary", "attrs", "source_ref", F.lit(group).alias("group_id"), "pos")


def edges_of(extractions: DataFrame, nodes: DataFrame, group: str = GROUP) -> tuple[DataFrame, DataFrame]:
    """Edges between entities of the same extraction, and the relations dropped since an end is none of its entities."""
    rel = extractions.select("source_ref", F.inline("relations"))
    ends = nodes.groupBy("source_ref", "key").agg(F.max_by("uuid", "pos").alias("uuid"))  # the last of a key
    side = lambda name: ends.select("source_ref", F.col("key").alias(f"{name}_key"), F.col("uuid").alias(f"{name}_uuid"))
    joined = rel.join(side("source"), ["source_ref", "source_key"], "left").join(side("target"), ["source_ref", "target_key"], "left")
    whole = F.col("source_uuid").isNotNull() & F.col("target_uuid").isNotNull()
    said = [F.col(c).cast("string") for c in ("source_uuid", "target_uuid", "name", "fact", "valid_at", "invalid_at", "source_ref")]
    uuid = F.sha2(F.to_json(F.array(F.lit(group), *said)), 256)  # nulls and separators inside stay apart
    edges = joined.where(whole).select(uuid.alias("uuid"), "source_uuid", "target_uuid", "name", "fact", "valid_at", "invalid_at", "source_ref", F.lit(group).alias("group_id"))
    return edges, joined.where(~whole).select("source_ref", "source_key", "target_key", "name")


def distinct(incoming: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """A row per uuid: the last by ``order`` of several."""
    return incoming.groupBy("uuid").agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")


def _root(root: str, group: str) -> str:
    return f"{root}/graph/group_id={group}"  # a tenant's log is its own


def nodes(spark: SparkSession, root: str, group: str = GROUP) -> DataFrame:
    return deltas.read(spark, _root(root, group), "nodes", NODES)


def edges(spark: SparkSession, root: str, group: str = GROUP) -> DataFrame:
    return deltas.read(spark, _root(root, group), "edges", EDGES)


def compact_graph(spark: SparkSession, root: str, group: str = GROUP) -> int | None:
    """One transaction in place of all so far; None if there is at most one."""
    return deltas.compact(spark, _root(root, group), {"nodes": NODES, "edges": EDGES})


def write_graph(extractions: DataFrame, root: str, group: str = GROUP, *, dry_run: bool = False) -> DataFrame:
    """Upserts entities and relations of EXTRACTION rows; a row ``nodes_created, nodes_reused, edges_created, edges_dropped``.

    Nodes are the same if group, type and key are; entities are counted one by one, also those
    of one node. A dry run counts and writes nothing.
    """
    spark = extractions.sparkSession
    new = nodes_of(extractions, group)
    linked, dropped = edges_of(extractions, new, group)
    known = nodes(spark, root, group).select("uuid").withColumn("known", F.lit(True))
    reused = F.count_if(F.col("known").isNotNull())
    counts = new.join(known, "uuid", "left").agg((F.count(F.lit(1)) - reused).alias("nodes_created"), reused.alias("nodes_reused"))
    numbers = counts.first() + linked.agg(F.count(F.lit(1))).first() + dropped.agg(F.count(F.lit(1))).first()
    if not dry_run:
        columns = lambda schema: spark.createDataFrame([], schema).columns
        deltas.write(_root(root, group), {"nodes": distinct(new, columns(NODES), F.struct("source_ref", "pos")), "edges": distinct(linked, columns(EDGES), F.struct("source_ref", "valid_at"))})
    return spark.createDataFrame([tuple(numbers)], "nodes_created long, nodes_reused long, edges_created long, edges_dropped long")


def episodes(docs: DataFrame, group: str = GROUP) -> DataFrame:
    """Episodes of normalised documents: when they were changed, else made, else now; every source is of the kind text."""
    at = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("timestamp")
    url = F.when(F.col("url") != "", F.concat(F.lit(" ("), F.col("url"), F.lit(")"))) if "url" in docs.columns else F.lit(None)
    said = F.concat(F.col("source_type"), F.lit(":"), F.col("id_source"), F.coalesce(url, F.lit("")))
    return docs.select(
        "episode_key", "content_hash", F.col("title").alias("name"), "body", said.alias("source_description"),
        F.coalesce(at("modified_at"), at("created_at"), F.current_timestamp()).alias("reference_time"), F.lit("text").alias("kind"), F.lit(group).alias("group_id"),
    )


def unseen(docs: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """Adds ``skipped``: whether the last content of the same key, in this batch by ``order`` or else in the ledger, is the same."""
    last = ledger.latest(seen).select("episode_key", F.col("content_hash").alias("before"))
    own = F.lag("content_hash").over(Window.partitionBy("episode_key").orderBy(order))
    return docs.join(last, "episode_key", "left").withColumn("skipped", F.coalesce(F.coalesce(own, "before") == F.col("content_hash"), F.lit(False))).drop("before")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def ingest(docs: DataFrame, root: str, batch: str, *, order: str = "id_source", group: str = GROUP, dry_run: bool = False, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ingests normalised documents as one batch: ``episode_key, skipped`` of each, as one after another by ``order`` would give.

    The ledger is read without this batch's own rows and written last, so that a batch done again has the
    same result. ``extract`` makes EXTRACTION rows of the new episodes, which are written to the graph. A dry run writes nothing.
    """
    spark = docs.sparkSession
    seen = _table(spark, f"{root}/ledger", LEDGER).where(F.col("batch") != batch).drop("batch")
    marked = unseen(ledger.with_keys(docs), seen, order)
    if dry_run:
        return marked.select("episode_key", "skipped")
    new = marked.where(~F.col("skipped"))
    path = f"{root}/episodes/batch={batch}"
    episodes(new, group).write.mode("overwrite").parquet(path)
    if extract is not None:
        write_graph(extract(spark.read.parquet(path)), root, group)
    keys = new.groupBy("episode_key").agg(F.max_by("content_hash", order).alias("content_hash")).withColumn("ingested_at", F.current_timestamp())
    keys.write.mode("overwrite").parquet(f"{root}/ledger/batch={batch}")
    return marked.select("episode_key", "skipped")
