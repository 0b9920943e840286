"""Tables as a log of deltas: batches write their own rows, commits are one file, reads merge.

A transaction writes its rows of each table to folders of its own and then claims the next
number in the log, as a file that only one writer can create; until then no reader
sees any of it, and afterwards all of it, in all tables. A writer that finds the
number taken takes the next one: deltas of several writers are all kept, and of rows with the
same key the last committed counts. A compaction writes what a reader would see and names the
transactions that it stands for; one that finds that another compaction came first gives up.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph import storage


class Conflict(RuntimeError):
    """Another writer has changed what this one was about to replace."""


def entries(spark: SparkSession, root: str) -> list[dict]:
    """The committed transactions, by number."""
    names = [x for x in storage.names(spark, f"{root}/log") if x.endswith(".json") and not x.startswith(("_", "."))]
    if not names:
        return []
    rows = spark.read.text([f"{root}/log/{x}" for x in names], wholetext=True).collect()  # a short file a transaction; compaction and vacuum keep them few
    return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["number"])


def live(found: list[dict]) -> list[dict]:
    """The transactions that no compaction stands for."""
    gone = {t for e in found for t in e["replaces"]}
    return [e for e in found if e["txn"] not in gone]


def _claim(spark: SparkSession, root: str, entry: dict) -> bool:
    """Writes an entry under its number; False if there is one already."""
    fs, folder = storage.file_system(spark, f"{root}/log")
    fs.mkdirs(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = path(folder, f"_{uuid.uuid4().hex}"), path(folder, f"{entry['number']:020d}.json")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    local = fs.makeQualified(part).toUri()
    try:
        if local.getScheme() == "file":  # where a rename would replace the file
            try:
                os.link(local.getPath(), urlparse(fs.makeQualified(whole).toString()).path)
            except FileExistsError:
                return False
            return True
        return bool(fs.rename(part, whole))
    finally:
        fs.delete(part, False)


def _commit(spark: SparkSession, root: str, txn: str, tables: list[str], replaces: list[str], base: int | None) -> int:
    while True:
        found = entries(spark, root)
        if base is not None and any(e["number"] > base and e["replaces"] for e in found):
            raise Conflict("another compaction was committed first")
        number = found[-1]["number"] + 1 if found else 1
        if _claim(spark, root, {"number": number, "txn": txn, "tables": tables, "replaces": replaces, "state": number if base is None else base}):
            return number


def write(root: str, frames: dict[str, DataFrame], *, replaces: list[str] | None = None, base: int | None = None) -> int:
    """Commits rows of several tables at once; the transaction's number. What a failed one has written goes."""
    spark = next(iter(frames.values())).sparkSession
    txn = uuid.uuid4().hex
    try:
        for table, df in frames.items():
            df.write.parquet(f"{root}/{table}/txn={txn}")
        return _commit(spark, root, txn, list(frames), replaces or [], base)
    except BaseException:
        for table in frames:
            storage.delete(spark, f"{root}/{table}/txn={txn}")
        raise


def read(spark: SparkSession, root: str, table: str, schema: str, key: str = "uuid", *, found: list[dict] | None = None) -> DataFrame:
    """The table's rows, the last committed of each key; empty where there are none."""
    own = [e for e in live(entries(spark, root) if found is None else found) if table in e["tables"]]
    if not own:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, txn string").option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/txn={e['txn']}" for e in own])
    if len(own) == 1:
        return rows.drop("txn")  # keys are distinct within a transaction
    states = F.create_map(*[F.lit(x) for e in own for x in (e["txn"], e["state"] * 2 + (not e["replaces"]))])  # a compaction's rows come before a delta of the same state
    columns = [c for c in rows.columns if c not in ("txn", key)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.element_at(states, F.col("txn"))).alias("r"))
    return last.select(key, "r.*").select(*spark.createDataFrame([], schema).columns)


def compact(spark: SparkSession, root: str, schemas: dict[str, str], key: str = "uuid") -> int | None:
    """Writes each table's state as one transaction, which stands for those so far; deltas that are committed meanwhile stay on top. None if there is at most one."""
    found = entries(spark, root)
    own = live(found)
    if len(own) < 2:
        return None
    tables = sorted({t for e in own for t in e["tables"]})
    return write(root, {t: read(spark, root, t, schemas[t], key, found=found) for t in tables}, replaces=[e["txn"] for e in own], base=found[-1]["number"])


def vacuum(spark: SparkSession, root: str) -> None:
    """Deletes the rows of transactions that a compaction stands for. Readers that began before it may fail, and begin again."""
    found = entries(spark, root)
    kept = {e["txn"] for e in live(found)}
    for e in found:
        if e["txn"] not in kept:
            for table in e["tables"]:
                storage.delete(spark, f"{root}/{table}/txn={e['txn']}")
