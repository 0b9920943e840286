"""Best-fit packing of token sequences, improved by swap-based local search.

Texts are tokenised where they lie; only their pieces' lengths move. Pieces
are dealt by a hash to groups of about GROUP, so that each group has pieces
of all lengths however the rows lie, and are packed there; the pieces of
sequences that are not nearly full are dealt out and packed once more.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged

CAPACITY = 2048
#: Pieces that are packed together.
GROUP = 8192
#: Sequences filled less than this are packed again with those of other tasks.
LOOSE = 0.99
#: Sequences to pack again (8 bytes each) up to which their numbers are broadcast.
BROADCAST_ROWS = 500_000
_BLOCK = 1 << 20
_CUT = re.compile(r"[A-Za-z] (?=[A-Za-z])")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ž]*")


@functools.lru_cache(maxsize=2)
def _encoders(stem: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{stem}.json"))
    special = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or r"(?!)")
    with open(public_tokenizers.path(f"{stem}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return whole, special, tiktoken.Encoding(stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, stem: str = "byte_bpe_50k") -> np.ndarray:
    """The tokenizer's ids of a whole text, as ``encode(text, add_special_tokens=False)`` gives them.

    The vocabulary exists in two forms that give the same ids. Texts of
    ordinary Latin letters, digits and signs go by the faster one; all others,
    and those that hold the string of a special token, by the tokenizer file itself. Very long texts are cut before a blank
    between two letters, where no token reaches across.
    """
    whole, special, fast = _encoders(stem)
    parts, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + _BLOCK) if len(text) - at > _BLOCK else None
        end = cut.end() - 1 if cut else len(text)
        part = text[at:end]
        plain = _PLAIN.match(part).end() == len(part) and not special.search(part)
        parts.append(np.array(fast.encode_ordinary(part) if plain else whole.encode(part, add_special_tokens=False).ids, dtype="<u4"))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def pieces(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)``; only the first piece may be shorter than the capacity if there are several."""
    n = -(-len(ids) // capacity)
    first = len(ids) - (n - 1) * capacity
    out = []
    for i in range(n):
        start = first + (i - 1) * capacity if i else 0
        part = ids[start : start + (capacity if i else first)]
        out.append((i, start, len(part), zlib.crc32(part.tobytes())))
    return out


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each length, by best fit over decreasing lengths."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms, made = 0, 0  # rooms: bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        free[room - need].append(b)
        if room > need:
            rooms |= 1 << (room - need)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY, patience: int = 12) -> np.ndarray:
    """Empty bins by moves and by exchanges (one for one, two for one) with fuller bins.

    Each step takes an item x out of one of the least filled bins and into a
    bin that is at least as full, which may give back one or two smaller
    items; the sum of squared fills grows, so that no state returns. It ends
    at the bound of ceil(total / capacity) bins, or when no step is found from
    any of the ``patience`` least filled bins.
    """
    lengths, bins = lengths.astype(np.int64), bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    while np.count_nonzero(fill) > least:
        room = capacity - fill
        open_bins = np.flatnonzero((fill > 0) & (room > 0))
        improved = False
        usable = np.flatnonzero(room[bins] > 0)
        usable = usable[np.argsort(bins[usable], kind="stable")]
        same = [(usable[:-k], usable[k:]) for k in (1, 2, 3) if len(usable) > k]
        ones = usable
        twos = [np.concatenate([a[m] for (a, b) in same if (m := bins[a] == bins[b]).any()] or [usable[:0]]), np.concatenate([b[m] for (a, b) in same if (m := bins[a] == bins[b]).any()] or [usable[:0]])]
        give = np.concatenate([np.zeros(len(open_bins), dtype=np.int64), lengths[ones], lengths[twos[0]] + lengths[twos[1]]])
        where = np.concatenate([open_bins, bins[ones], bins[twos[0]]])
        for s in open_bins[np.argsort(fill[open_bins], kind="stable")][:patience]:
            best = None
            for x in sorted(np.flatnonzero(bins == s).tolist(), key=lambda i: (-lengths[i], i)):
                gain = lengths[x] - give
                ok = (gain > 0) & (gain <= room[where]) & (where != s) & (fill[where] >= fill[s])
                if ok.any():
                    at = int(np.argmax(np.where(ok, 2 * gain * (fill[where] - fill[s] + gain), -1)))
                    score = int(2 * gain[at] * (fill[where[at]] - fill[s] + gain[at]))
                    if best is None or score > best[0]:
                        best = (score, x, at)
            if best:
                _, x, at = best
                b, k = int(where[at]), at - len(open_bins)
                back = [] if k < 0 else [ones[k]] if k < len(ones) else [twos[0][k - len(ones)], twos[1][k - len(ones)]]
                bins[x] = b
                for y in back:
                    bins[y] = s
                gain = int(lengths[x] - give[at])
                fill[b] += gain
                fill[s] -= gain
                improved = True
                break
        if not improved:
            break
    return bins


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Dense bin numbers and offsets of each length (all from 1 to ``capacity``)."""
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    bins = np.unique(bins, return_inverse=True)[1]
    offsets = np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    begins = ends - lengths[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, dtype=bool)
    offsets[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
    return bins, offsets


#: Keys travel as text: pandas would turn a long column that has nulls into doubles.
_PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECE}, sequence_id long, offset long"


def _packed(pieces: DataFrame, shards: int, first: int, capacity: int) -> DataFrame:
    """Pieces with sequence numbers (from ``first``) and offsets, packed in groups by their hash ``deal``."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("deal", ignore_index=True)
        bins, part["offset"] = pack(part["length"].to_numpy(dtype=np.int64), capacity)
        part["sequence_id"] = first + part["shard"].astype("int64") * (1 << 24) + bins
        return part.drop(columns=["deal", "shard"])

    names = [c.split()[0] for c in _PIECE.split(", ")]
    dealt = pieces.select(*names, "deal", F.pmod("deal", F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(one, _PACKED)


def pack_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP, stem: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone. Rows with null or repeated
    keys are packed each for itself. No rows: no pieces.
    """
    encoders = _encoders  # loaded once per worker

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders(stem)
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = np.append(token_ids(body, stem), np.uint32(0)).astype("<u4")
                out += [(doc, *p) for p in pieces(ids, capacity)]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    deal = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    made = staged(rows.mapInPandas(cut, _PIECE).withColumn("deal", deal), "pieces")
    shards = max(1, round(made.count() / group))
    done = staged(_packed(made, shards, 0, capacity), "packed")
    discard(made)
    fills = done.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < LOOSE * capacity)
    fills = staged(fills.select("sequence_id"), "packed_loose")
    n = fills.count()
    as_long = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("long"))
    if n < 2:
        return as_long(done)
    small = n <= BROADCAST_ROWS
    loose = F.broadcast(fills) if small else fills
    rest = done.join(loose, "sequence_id", "left_semi").withColumn("deal", F.xxhash64("sequence_id", F.lit(3)))
    again = _packed(rest, max(1, round(4 * n / group)), 1 << 62, capacity)
    return as_long(done.join(loose, "sequence_id", "left_anti").unionByName(again))
