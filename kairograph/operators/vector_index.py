"""A vector index of cells around pivots, searched exactly.

Vectors of a length lie in the cell of their nearest pivot and, within it, in a
ring of distances to it. For a query at distance d from a pivot, the triangle
inequality keeps all vectors of a ring [low, high] at a distance of at least
max(d - high, low - d). A search scores a query's nearest rings until they hold enough
vectors, and then those other rings that may still hold a nearer one than the n-th. Distances
are those of vectors of length one, which order as cosines do. Where nothing is
clustered rings exclude little, and a search reads what a scan would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph import storage
from kairograph.operators import retrieval

#: Pivots of a length: the root of its vectors, but no more than fit in so many bytes.
PIVOT_BYTES = 32 << 20
#: Vectors of which a task writes so many at most, if a cell has most of them.
FILE_ROWS = 1_000_000
#: Rings of a cell are so wide.
WIDTH = 0.05
#: Query vectors that are searched at once.
QUERY_BLOCK = 1024
#: Numbers of a matrix of distances or scores that are held at once.
CELLS = 1 << 20
_SLACK = 1e-5  # scores are rounded to six places


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def build(vectors: DataFrame, path: str, *, lower: str | None = None, upper: str | None = None) -> None:
    """Writes ``vec_id, embedding`` (with bounds ``lower`` and ``upper`` between which a vector holds) by cell and ring.

    Vectors that are null, zero, or have a null or non-finite component are left out. Pivots are the vectors
    with the least hashes; their number is bounded by PIVOT_BYTES.
    """
    spark = vectors.sparkSession
    bound = lambda c, name: (F.col(c) if c else F.lit(None)).cast("double").alias(name)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.where(retrieval.comparable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), bound(lower, "low"), bound(upper, "high"), F.size("embedding").alias("dim"))
    rows = storage.staged(rows, "vector_rows")  # embeddings are made once, and read three times more
    counts = sorted(rows.groupBy("dim").count().collect())  # few lengths
    written = None
    for dim, count in counts:
        own = rows.where(F.col("dim") == dim)
        pivots = min(int(count**0.5) + 1, max(1, PIVOT_BYTES // (8 * dim)))
        hashed = own.select(F.xxhash64("embedding").alias("h"), "embedding")
        last = hashed.select("h").distinct().orderBy("h").limit(pivots).agg(F.max("h")).first()[0]  # only hashes move
        chosen = hashed.where(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").limit(pivots).collect()  # PIVOT_BYTES
        shared = spark.sparkContext.broadcast(_unit([r["embedding"] for r in chosen]))
        spark.createDataFrame([(dim, i, r["embedding"]) for i, r in enumerate(chosen)], "dim int, cell int, pivot array<double>").coalesce(1).write.parquet(f"{path}/pivots/dim={dim}")
        dealt = own.mapInPandas(_deal(shared), f"vec_id long, embedding {kind}, low double, high double, dim int, cell int, ring int, distance double")
        written = dealt if written is None else written.unionByName(dealt)
    if written is None:
        return
    pieces = -(-sum(count for _, count in counts) // FILE_ROWS)
    written.repartition("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, pieces)))).sortWithinPartitions("dim", "cell", "ring").write.partitionBy("dim", "cell").parquet(f"{path}/vectors")
    read = spark.read.parquet(f"{path}/vectors")
    rings = read.groupBy("dim", "cell", "ring").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    rings.coalesce(1).write.parquet(f"{path}/rings")  # a row per ring: pivots times 2 / WIDTH at most


def _deal(shared):
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared.value
        step = max(1, CELLS // max(pivots.shape))
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.iloc[start : start + step]
                d = _distances(_unit(batch["embedding"]), pivots)
                cell = d.argmin(axis=1)
                distance = d[np.arange(len(batch)), cell]
                yield batch.assign(cell=cell.astype(np.int32), ring=(distance / WIDTH).astype(np.int32), distance=distance)

    return deal


def search(spark: SparkSession, path: str, queries: DataFrame, n: int = 10, *, own: bool = False, at: str | None = None, counts: list | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank``: the result of ``retrieval.cosine_search`` over the indexed vectors.

    Queries go in blocks of QUERY_BLOCK, as matrices that are broadcast. ``counts`` may be two accumulators: of
    pairs of a query and a vector that were scored, and of vectors read.
    """
    empty = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    if "rings" not in storage.names(spark, path):
        return empty
    moment = (F.col(at) if at else F.lit(None)).cast("double")
    asked = queries.where(retrieval.comparable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), moment.alias("at"), F.size("embedding").alias("dim"))
    rings = spark.read.parquet(f"{path}/rings").toPandas()  # pivots times 2 / WIDTH rows at most
    vectors = spark.read.parquet(f"{path}/vectors")
    found = None
    for dim, count in sorted(asked.groupBy("dim").count().collect()):
        kept = rings[rings["dim"] == dim].sort_values(["cell", "ring"])
        if not len(kept):
            continue
        pivots = _unit([r["pivot"] for r in spark.read.parquet(f"{path}/pivots/dim={dim}").orderBy("cell").collect()])
        blocks = -(-count // QUERY_BLOCK)
        for b in range(blocks):
            items = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).collect()
            if items:
                near = _block(spark, vectors.where(F.col("dim") == dim), kept, pivots, items, n, own, counts)
                found = near if found is None else found.unionByName(near)
    return empty if found is None else retrieval.top(found, "query_id", "vec_id", n)


def _block(spark: SparkSession, vectors: DataFrame, rings: pd.DataFrame, pivots: np.ndarray, items: list, n: int, own: bool, counts: list | None) -> DataFrame:
    q = _unit([r["embedding"] for r in items])
    away = _distances(q, pivots).astype(np.float32)  # its error is far below _SLACK
    cell, close, far, size = (rings[c].to_numpy() for c in ("cell", "near", "far", "n"))
    ids, at = np.array([r["vec_id"] for r in items]), np.array([np.nan if r["at"] is None else r["at"] for r in items])
    step = max(1, CELLS // len(rings))
    parts = [slice(i, i + step) for i in range(0, len(items), step)]
    least = lambda part: _least(away[part][:, cell], close, far)
    pairs = []  # of a ring and a query: few rings hold enough vectors
    for part in parts:
        order = np.argsort(least(part), axis=1, kind="stable")
        i, k = np.nonzero(np.cumsum(size[order], axis=1) - size[order] < 2 * n + 1)
        pairs.append(np.stack([order[i, k], i + part.start], axis=1))
    first = np.concatenate(pairs)
    first = first[np.lexsort((first[:, 1], first[:, 0]))]
    run = lambda used, reach: _scored(spark, vectors, rings, used, first, reach, away, q, ids, at, n, own, counts)
    near = storage.staged(run(np.unique(first[:, 0]), None), "vector_hits")  # n rows a query and task
    score = {r["query_id"]: r["s"] for r in retrieval.top(near, "query_id", "vec_id", n).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("k")).where(F.col("k") == n).collect()}
    reach = np.array([np.sqrt(max(0, 2 - 2 * (score.get(i, -2) - _SLACK))) for i in ids.tolist()]) + _SLACK  # fewer than n: everything
    used = np.zeros(len(rings), dtype=bool)
    for part in parts:
        rest = least(part) <= reach[part][:, None]
        own_ = first[(first[:, 1] >= part.start) & (first[:, 1] < part.stop)]
        rest[own_[:, 1] - part.start, own_[:, 0]] = False
        used |= rest.any(axis=0)
    return near.unionByName(run(np.flatnonzero(used), reach)) if used.any() else near


def _least(away: np.ndarray, near, far) -> np.ndarray:
    """The least distance of a ring's vectors to a query, by the query's distance from the pivot."""
    return np.maximum(0, np.maximum(away - far, near - away))


def _scored(spark: SparkSession, vectors: DataFrame, rings: pd.DataFrame, used: np.ndarray, first: np.ndarray, reach: np.ndarray | None, away: np.ndarray, q: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int, own: bool, counts: list | None) -> DataFrame:
    """The n best of each query among the vectors of the rings that it wants; cells that none wants aren't read.

    A query wants its ``first`` rings (pairs of ring and query), or with ``reach`` those others that may hold a vector within it. Tasks
    find a ring's queries from their distances to its pivot, so that what is broadcast grows with rings and with queries, not with their product.
    """
    cells = sorted(set(rings["cell"].to_numpy()[used].tolist()))
    kept = rings.iloc[used]
    opens = np.searchsorted(first[:, 0], used), np.searchsorted(first[:, 0], used, side="right")
    shared = spark.sparkContext.broadcast((kept["cell"].to_numpy().astype(np.int64) << 32 | kept["ring"].to_numpy(), kept["near"].to_numpy(), kept["far"].to_numpy(), *opens, first[:, 1].astype(np.int32), reach, away, q, ids, at))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, near, far, opens, ends, first, reach, away, q, ids, at = shared.value
        step = max(1, CELLS // max(1, *q.shape))
        for whole in batches:
            for (cell, ring), group in whole.groupby(["cell", "ring"]):
                if counts is not None:
                    counts[1].add(len(group))
                key = int(cell) << 32 | int(ring)
                i = np.searchsorted(keys, key)
                if i == len(keys) or keys[i] != key:
                    continue
                asks = first[opens[i] : ends[i]]
                if reach is not None:
                    asks = np.setdiff1d(np.flatnonzero(_least(away[:, cell], near[i], far[i]) <= reach), asks)
                if not len(asks):
                    continue
                if counts is not None:
                    counts[0].add(len(group) * len(asks))
                for start in range(0, len(group), step):
                    batch = group.iloc[start : start + step]
                    vec = batch["vec_id"].to_numpy()
                    s = np.round(_unit(batch["embedding"]) @ q[asks].T, 6)
                    if not own:
                        s[vec[:, None] == ids[asks][None, :]] = -np.inf
                    s[retrieval.outside(batch, at[asks])] = -np.inf
                    yield retrieval.best(s, ids[asks], vec, n, "query_id", "vec_id")

    rows = vectors.where(F.col("cell").isin(cells)).select("cell", "ring", "vec_id", "embedding", "low", "high")
    return rows.mapInPandas(score, "query_id long, vec_id long, score double")
