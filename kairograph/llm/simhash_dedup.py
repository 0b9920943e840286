"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

(Pagh, "Locality-sensitive hashing without false negatives", 2016.) Each bit
position gets a non-zero vector of radius+1 bits; table v keeps the positions
whose vector has odd inner product with v. Any ``radius`` positions leave some
v orthogonal to all their vectors, so that a pair within the radius agrees on
all the bits that table keeps. With radius 2 there are 7 tables of about 37
bits.

Buckets of two are compared directly. Larger buckets never become pairs: every
member is sent to itself and to the fingerprints one free bit away. Two
fingerprints within two bits share such a midpoint, members of a midpoint are
within two bits of each other, and it can't have more than 65 members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._shared import staged, text_bytes, word_blocks
from .components import connected_components

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42


def simhash(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """The 8 bytes, most significant first, of a text's fingerprint; no words: zeros."""
    digest = xxhash.xxh64_digest
    ones, total, carry, done = np.zeros(BITS, dtype=np.int64), 0, [], False
    for words in word_blocks(data):
        words = carry + words
        if len(words) >= shingle:
            done = True
            joined = b" ".join(words)
            starts = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
            hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle - 1].tolist(), (starts[shingle:] - 1).tolist(), strict=True)])
            bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
        carry = words[1 - shingle :]
    if not done and carry:
        ones += np.unpackbits(np.frombuffer(digest(b" ".join(carry), seed), dtype=np.uint8))
        total = 1
    return np.packbits(2 * ones > total).tobytes() if total else bytes(8)


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([int.from_bytes(simhash(x), "big", signed=True) for x in texts], dtype="int64")


def fingerprint(data: Column) -> Column:
    """The fingerprint, as a signed long, of UTF-8 bytes."""
    return F.pandas_udf(_fingerprints, LongType())(data)


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """One mask per table, as unsigned integers."""
    count = 2 ** (radius + 1) - 1
    vector = [1 + i * 5 % count for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, count + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints within RADIUS bits of
    each other; ``prints`` has distinct long values ``fp``. Not every linked
    pair is listed, but every linked pair is connected through edges listed."""
    masks = covering_masks()
    fp = F.col("fp")
    keys = prints.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    buckets = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets = staged(buckets, "simhash_buckets")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    free = F.array(*[F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    near = (
        keys.join(buckets.where("n > 2").select("t", "k"), ["t", "k"])
        .select("fp", F.explode(F.transform(F.element_at(free, F.col("t") + 1), lambda x: fp.bitwiseXOR(x))).alias("mid"))
        .groupBy("mid").agg(F.collect_set("fp").alias("all"))  # 65 values at most
        .where(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
        .where("a != b")
    )
    return pairs.unionByName(near)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Null and empty texts have fingerprint zero, linked like any other.
    Repeated keys keep a row each. Rows with a null key take part;
    ``component_id`` is the smallest non-null key reachable, null where there is none.
    """
    rows = staged(docs.select(F.col(key).cast("long").alias("doc_id"), fingerprint(text_bytes(text)).alias("fp")), "simhash")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(link(prints.select("fp")))
    classes = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = staged(classes, "simhash_classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
