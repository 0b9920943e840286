"""Exact cosine links between embeddings by dual traversal of cover trees.

On unit vectors cosine >= c means distance <= sqrt(2-2c). Distinct vectors of
a label are cut into blocks of bounded size: cells around pivots, and hash
parts of a cell that is too large. Each block becomes a cover tree: nested
levels whose covering radii halve. Spark pairs the blocks of a label by the
bound |c1-c2| <= r1+r2+limit on their centres and covering radii; a task
traverses two trees at once and prunes node pairs by the same bound. What is
left is compared exactly in double precision.

A task returns, for the vectors of its two blocks, how many they link with
and a spanning forest of the links, never the links themselves: a group of
thousands of near copies gives rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged
from .components import connected_components

COSINE = 0.98
#: Vectors in a block, about.
BLOCK = 1024
#: Pivots per label, and in all (their table is broadcast).
PIVOTS, ALL_PIVOTS = 64, 50_000
_LEAF = 48
_SLACK = 1e-7


@dataclass
class Node:
    rows: np.ndarray  # of the block
    center: int
    radius: float
    children: list[Node] = field(default_factory=list)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, initial=0)
    far = (most > 1e150) | (most < 1e-150)  # squares would overflow or vanish
    x[far] /= most[far, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def build(x: np.ndarray, rows: np.ndarray | None = None, center: int = 0, radius: float | None = None) -> Node:
    """Cover tree of unit vectors; a node's center is also the center of its first child."""
    rows = np.arange(len(x)) if rows is None else rows
    dist = np.sqrt(np.maximum(0, 2 - 2 * (x[rows] @ x[center])))
    node = Node(rows, center, float(dist.max()))
    if len(rows) <= _LEAF or node.radius < 1e-6:
        return node
    half = min(radius or node.radius, node.radius) / 2
    near = dist <= half
    groups, rest, at = [(rows[near], center)], rows[~near], None
    while len(rest):
        at = int(rest[0])
        near = np.sqrt(np.maximum(0, 2 - 2 * (x[rest] @ x[at]))) <= half
        near[0] = True
        groups.append((rest[near], at))
        rest = rest[~near]
    node.children = [build(x, r, c, half) for r, c in groups]
    return node


def _hits(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(x[rx] @ y[ry].T >= cosine)
    return rx[i], ry[j]


def dual(x: np.ndarray, a: Node, y: np.ndarray, b: Node, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs with cosine >= ``cosine`` between two trees, in parts."""
    limit = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        left, right = p.children or [p], q.children or [q]
        if not p.children and not q.children:
            yield _hits(x, y, p.rows, q.rows, cosine)
            continue
        gap = np.sqrt(np.maximum(0, 2 - 2 * (x[[n.center for n in left]] @ y[[n.center for n in right]].T)))
        keep = gap <= np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])[None, :] + limit
        leaf_l = np.array([not n.children for n in left])
        leaf_r = np.array([not n.children for n in right])
        both = keep & leaf_l[:, None] & leaf_r[None, :]
        # pairs of leaves, most of them single vectors: one product over the leaves that some pair keeps
        li, ri = np.flatnonzero(both.any(axis=1)), np.flatnonzero(both.any(axis=0))
        for at in range(0, len(li), 256):
            part = li[at : at + 256]
            cols = np.flatnonzero(both[part].any(axis=0))
            if len(cols):
                yield _hits(x, y, np.concatenate([left[i].rows for i in part]), np.concatenate([right[j].rows for j in cols]), cosine)
        del li, ri
        todo += [(left[i], right[j]) for i, j in zip(*np.nonzero(keep & ~both), strict=True)]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest vertex reachable from each of ``n`` vertices over edges (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        root = root[root]
        live = root[i] != root[j]
        if (root == before).all() and not live.any():
            break
        i, j = i[live], j[live]
    while (root[root] != root).any():
        root = root[root]
    return root


def link_blocks(ids_a, x, mult_a, ids_b, y, mult_b, same: bool, cosine: float = COSINE) -> pd.DataFrame:
    """Rows ``(a, b, n)``: with b null, vector a links with n others; else an edge of the forest."""
    ta = build(x)
    tb = ta if same else build(y)
    na, nb = len(x), len(y)
    deg_a, deg_b = np.zeros(na, dtype=np.int64), np.zeros(nb, dtype=np.int64)
    root = np.arange(na if same else na + nb)
    for i, j in dual(x, ta, y, tb, cosine):
        if same:
            other = i != j
            i, j = i[other], j[other]
        if not len(i):
            continue
        deg_a += np.bincount(i, weights=mult_b[j], minlength=na).astype(np.int64)
        if not same:
            deg_b += np.bincount(j, weights=mult_a[i], minlength=nb).astype(np.int64)
        k = j if same else j + na
        root = forest(len(root), np.concatenate([np.arange(len(root)), i]), np.concatenate([root, k]))
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    deg = deg_a if same else np.concatenate([deg_a, deg_b])
    has, up = np.flatnonzero(deg), np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({
        "a": np.concatenate([ids[has], ids[up]]),
        "b": pd.array([None] * len(has), dtype="Int64").tolist() + ids[root[up]].tolist(),
        "n": np.concatenate([deg[has], np.zeros(len(up), dtype=np.int64)]),
    }).astype({"b": "Int64"})


def _blocks(vectors: DataFrame) -> DataFrame:
    """``nid, mult, label, dim, v`` plus ``cell`` and ``part``."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    big = staged(sizes, "embedding_sizes")
    total = big.agg(F.coalesce(F.sum(F.least(F.lit(PIVOTS), F.ceil(F.col("n") / BLOCK))), F.lit(0))).first()[0]
    least = max(1.0, total / ALL_PIVOTS)  # fewer pivots a label if there are very many labels
    draw = F.pmod(F.xxhash64("nid", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / BLOCK)) / F.lit(least)
    sample = vectors.join(big, ["label", "dim"]).where(draw < wanted / F.col("n")).select("label", "dim", "v").collect()  # about ALL_PIVOTS vectors at most
    pivots: dict[tuple, np.ndarray] = {}
    for r in sample:
        pivots.setdefault((r["label"], r["dim"]), []).append(r["v"])
    shared = spark.sparkContext.broadcast({k: unit(np.array(v)) for k, v in pivots.items()})

    def cell(labels: pd.Series, dims: pd.Series, vs: pd.Series) -> pd.Series:
        out = np.zeros(len(vs), dtype=np.int64)
        for k, at in pd.DataFrame({"l": labels, "d": dims}).groupby(["l", "d"]).indices.items():
            if (p := shared.value.get(k)) is not None:
                out[at] = (unit(np.stack(vs.iloc[at].tolist())) @ p.T).argmax(axis=1)
        return pd.Series(out)

    celled = staged(vectors.withColumn("cell", F.pandas_udf(cell, "long")("label", "dim", "v")), "embedding_cells")
    counts = celled.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("parts"))
    return celled.join(counts, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")))


_BLOCK = "label long, dim int, cell long, part long, center array<double>, radius double, ids binary, mults binary, vs binary"


def _to_block(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("nid")
    v = np.stack(part["v"].tolist())  # floats or doubles, as they came
    x = unit(v)
    first = part.iloc[0]
    radius = float(np.sqrt(np.maximum(0, 2 - 2 * (x @ x[0]))).max())
    return pd.DataFrame([[first["label"], first["dim"], first["cell"], first["part"], x[0].tolist(), radius, part["nid"].to_numpy("<i8").tobytes(), part["mult"].to_numpy("<i8").tobytes(), v.tobytes()]], columns=["label", "dim", "cell", "part", "center", "radius", "ids", "mults", "vs"])


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``.

    Only vectors with equal non-null labels (and equal lengths) link. Vectors
    that are null, empty, zero or have a null, NaN or infinite component, and
    those without a label, link with nothing and are their own component.
    Exact copies link like any others. Rows with a null vec_id take part, but
    name no component: theirs is the smallest non-null vec_id, else null, and
    then they aren't kept. Repeated vec_ids keep a row each.
    """
    limit = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("label").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)
    rows = staged(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v")).withColumn("valid", F.coalesce(valid, F.lit(False))), "embedding_rows")
    good = rows.where("valid")
    distinct = good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("nid"), "mult", "least", "label", F.size("v").alias("dim"), "v"), "embedding_distinct")
    blocks = staged(_blocks(distinct.drop("least")).groupBy("label", "dim", "cell", "part").applyInPandas(_to_block, _BLOCK), "embedding_blocks")

    meta = blocks.select("label", "dim", "cell", "part", "center", "radius")
    left = meta.select("label", "dim", *[F.col(c).alias(f"{c}_a") for c in ("cell", "part", "center", "radius")])
    right = meta.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("cell", "part", "center", "radius")])
    dot = F.aggregate(F.zip_with("center_a", "center_b", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    ordered = F.struct("cell_a", "part_a") <= F.struct(F.col("cell_b").alias("cell_a"), F.col("part_b").alias("part_a"))
    pairs = (
        left.join(right, ["label", "dim"]).where(ordered)
        .where(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("radius_a") + F.col("radius_b") + limit)
        .select("label", "dim", "cell_a", "part_a", "cell_b", "part_b")
    )
    side = lambda s: blocks.select("label", "dim", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "part", "ids", "mults", "vs")])
    work = pairs.join(side("a"), ["label", "dim", "cell_a", "part_a"]).join(side("b"), ["label", "dim", "cell_b", "part_b"])
    work = work.repartition("label", "cell_a", "part_a", "cell_b", "part_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = [np.frombuffer(x, dtype="<i8") for x in (r.ids_a, r.ids_b)]
                mults = [np.frombuffer(x, dtype="<i8") for x in (r.mults_a, r.mults_b)]
                vs = [unit(np.frombuffer(x, dtype=f"<f{len(x) // (len(i) * r.dim)}").reshape(-1, r.dim)) for x, i in zip((r.vs_a, r.vs_b), ids, strict=True)]
                same = (r.cell_a, r.part_a) == (r.cell_b, r.part_b)
                yield link_blocks(ids[0], vs[0], mults[0], ids[1], vs[1], mults[1], same, cosine)

    found = staged(work.mapInPandas(compare, "a long, b long, n long"), "embedding_links")
    degree = found.where("b is null").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("nid"), "root")
    known = (
        distinct.join(degree, "nid", "left").join(roots, "nid", "left")
        .select("label", "v", "least", F.coalesce("root", "nid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    known = staged(known, "embedding_known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("label", "v", "n_links", "component_id")
    linked = good.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
