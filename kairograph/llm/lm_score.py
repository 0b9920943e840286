"""Document scores of a log-bilinear language model trained by noise-contrastive estimation.

(Mnih & Hinton, 2007; Mnih & Teh, 2012.) The model predicts the class of a
token from those of the two tokens before it. The most frequent tokens are a
class each, as many as the square root of the corpus' distinct tokens asks for;
rarer ones share a class with those of like frequency, and within a class follow
the counts of the whole training corpus. Normalisers come from
batched matrix products over all pairs of context classes.

Training texts, as class numbers, are dealt by a hash to shards of about
SHARD_TOKENS. In each of ROUNDS rounds every shard goes on, in numpy, from the
parameters averaged over all shards, which Spark sums up in a tree: the
result depends on the corpus, not on how its rows are partitioned.

Counts cover all training tokens. The most frequent ones (HEAD at most) are
broadcast; documents send only their other tokens to a join with the counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged, text_bytes, word_blocks

DIM, NOISE, BATCH = 16, 64, 4096
#: Classes at least and at most; the most is a bound on memory: three float32 tables of its square are broadcast, 48 MB in all.
FEWEST, MOST = 256, 2048
SHARD_TOKENS, ROUNDS, TREE = 1 << 21, 3, 32
#: Tokens whose counts are broadcast, at most.
HEAD = 200_000
#: Token counts that a task keeps before it sends them on.
_FLUSH = 400_000
#: A corpus smaller than this is gone through more than once.
_LEAST_TOKENS = 2_000_000
END = b""  # no word is empty
RARE, STOP = 0, 1  # class numbers


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_tokens(texts: DataFrame) -> DataFrame:
    """``token, c`` over all texts (binary column ``data``), the end of each counted as the empty token."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: Counter = Counter()
        frame = lambda: pd.DataFrame({"token": list(kept), "n": list(kept.values())})
        for batch in batches:
            for data in batch["data"]:
                for words in word_blocks(data):
                    kept.update(words)
                kept[END] += 1
                if len(kept) > _FLUSH:
                    yield frame()
                    kept.clear()
        if kept:
            yield frame()

    return texts.select("data").mapInPandas(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def start_model(class_counts: np.ndarray, dim: int = DIM) -> dict[str, np.ndarray]:
    """Parameters before training: the model then is the classes' smoothed frequencies."""
    draw = np.random.default_rng(7)
    k = len(class_counts)
    share = (class_counts + 0.5) / (class_counts + 0.5).sum()
    return {
        "r": draw.normal(0, 0.1, (k, dim)).astype(np.float32), "q": draw.normal(0, 0.1, (k, dim)).astype(np.float32),
        "c1": np.eye(dim, dtype=np.float32), "c2": np.eye(dim, dtype=np.float32), "b": np.log(share).astype(np.float32),
    }


def _targets(ids: np.ndarray) -> np.ndarray:
    """Places of tokens, without the two STOPs that begin each text; its end is a STOP as well."""
    stop = np.flatnonzero(ids == STOP)  # in threes, but for a text's end between: opening, opening, end
    opening = np.zeros(len(ids), dtype=bool)
    opening[stop[0::3]] = opening[stop[1::3]] = True
    return np.flatnonzero(~opening)


def train(model: dict[str, np.ndarray], ids: np.ndarray, noise: np.ndarray, steps: int, seed: int, rate: float = 0.1) -> dict[str, np.ndarray]:
    """Adagrad steps of noise-contrastive estimation on batches of places drawn from ``ids``, the class numbers of
    texts, of which each begins with two STOPs that are context only.

    The noise of a batch is NOISE classes drawn from the distribution ``noise``, shared by its examples.
    """
    p = {k: v.astype(np.float32).copy() for k, v in model.items()}
    power = {k: np.full_like(v, 1e-2) for k, v in p.items()}
    draw = np.random.default_rng(seed)
    places = _targets(ids)
    noise_upto = np.cumsum(noise)
    offset = np.log(NOISE * noise).astype(np.float32)
    k = len(noise)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def summed(at, rows):
        """Rows added up by number; a product with an indicator matrix in sorted order."""
        order = np.argsort(at.astype(np.uint16), kind="stable")
        new = np.flatnonzero(np.diff(at[order], prepend=-1))
        return at[order[new]], np.add.reduceat(rows[order], new, axis=0)

    for _ in range(steps):
        at = places[draw.integers(0, len(places), BATCH)]
        a, b, w = ids[at - 2], ids[at - 1], ids[at]
        other = np.searchsorted(noise_upto, draw.random(NOISE) * noise_upto[-1], side="right").clip(max=k - 1)
        ra, rb, qw, qn = p["r"][a], p["r"][b], p["q"][w], p["q"][other]
        h = ra @ p["c1"] + rb @ p["c2"]
        good = sigmoid((h * qw).sum(axis=1) + p["b"][w] - offset[w]) - 1  # gradients of the loss by the scores
        bad = sigmoid(h @ qn.T + p["b"][other] - offset[other])
        gh = good[:, None] * qw + bad @ qn
        said, g = summed(np.concatenate([w, other]), np.concatenate([np.c_[good[:, None] * h, good], np.c_[bad.T @ h, bad.sum(axis=0)]]))
        grads = {
            "q": (said, g[:, :-1]), "b": (said, g[:, -1]),
            "r": summed(np.concatenate([a, b]), np.concatenate([gh @ p["c1"].T, gh @ p["c2"].T])),
            "c1": (slice(None), ra.T @ gh), "c2": (slice(None), rb.T @ gh),
        }
        for name, (rows, g) in grads.items():
            g = g / BATCH
            power[name][rows] += g * g
            p[name][rows] -= rate * g / np.sqrt(power[name][rows])
    return p


def log_tables(model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``s1[a, w]``, ``s2[b, w]`` (with the bias) and ``z[a, b]``: log P(w | a, b) = s1 + s2 - z."""
    s1 = (model["r"] @ model["c1"] @ model["q"].T).astype(np.float32)
    s2 = (model["r"] @ model["c2"] @ model["q"].T + model["b"]).astype(np.float32)
    top1, top2 = s1.max(axis=1, keepdims=True), s2.max(axis=1, keepdims=True)
    z = np.log(np.exp(s1 - top1) @ np.exp(s2 - top2).T + np.float32(1e-37)) + top1 + top2.T
    return s1, s2, z


def class_ids(data: bytes, classes: dict[bytes, int]) -> np.ndarray:
    """Class of each token of a text, the end last."""
    parts = [np.fromiter((classes.get(w, RARE) for w in words), dtype=np.uint16, count=len(words)) for words in word_blocks(data)]
    return np.concatenate([*parts, np.array([STOP], dtype=np.uint16)])


def _shards(rows: DataFrame, shared, shards: int) -> DataFrame:
    """``shard, ids``: the class numbers of the texts of each shard."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value[0]
        two = np.full(2, STOP, dtype=np.uint16)
        for batch in batches:
            ids = [np.concatenate([two, class_ids(x, classes)]).tobytes() for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("deal"), pa.array(ids, pa.binary())], names=["deal", "ids"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["deal", "ids"])
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "ids": [b"".join(part["ids"])]})

    deal = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id().cast("string")), "data")
    numbered = rows.select(deal.alias("deal"), "data").mapInArrow(number, "deal long, ids binary")
    return staged(numbered.withColumn("shard", F.pmod("deal", F.lit(shards))).groupBy("shard").applyInPandas(join, "shard long, ids binary"), "lm_shards")


def _trained(dealt: DataFrame, start: dict, noise: np.ndarray, shards: int, passes: float) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS rounds of training on all shards and averaging."""
    spark = dealt.sparkSession
    names, model = list(start), start

    def add(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0]) // TREE], "weight": [part["weight"].sum()], "flat": [sum(np.frombuffer(x, dtype="<f8") for x in part["flat"]).tobytes()]})

    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, noise))

        def fit(batches: Iterator[pd.DataFrame], shared=shared, turn=turn) -> Iterator[pd.DataFrame]:
            model, noise = shared.value
            for batch in batches:
                for shard, data in zip(batch["shard"], batch["ids"], strict=True):
                    ids = np.frombuffer(data, dtype=np.uint16).astype(np.int64)
                    p = train(model, ids, noise, max(1, round(len(ids) * passes / (ROUNDS * BATCH))), 1000 * int(shard) + turn)
                    flat = np.concatenate([p[x].ravel() for x in names]).astype("<f8") * len(ids)
                    yield pd.DataFrame({"shard": [shard], "weight": [float(len(ids))], "flat": [flat.tobytes()]})

        sums, left = dealt.mapInPandas(fit, "shard long, weight double, flat binary"), shards
        while left > TREE:
            sums, left = sums.groupBy(F.floor(F.col("shard") / TREE)).applyInPandas(add, "shard long, weight double, flat binary"), -(-left // TREE)
        rows = sorted(sums.collect(), key=lambda r: r["shard"])  # TREE rows at most
        flat = sum(np.frombuffer(r["flat"], dtype="<f8") for r in rows) / sum(r["weight"] for r in rows)
        out, at = {}, 0
        for x in names:
            out[x] = flat[at : at + start[x].size].reshape(start[x].shape).astype(np.float32)
            at += start[x].size
        model = out
        shared.unpersist()
    return model


_TAIL = pa.schema([("rid", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("head", pa.float64()), ("head_rare", pa.float64()), ("n_rare", pa.int64()), ("classes", pa.float64()), ("token", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
_TAIL_DDL = "rid long, doc_id string, held_out boolean, n_tokens long, known long, head double, head_rare double, n_rare long, classes double, token array<binary>, times array<int>"


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Null and empty texts are the end token alone. Rows with null keys are
    training rows. Repeated rows count and are scored each for itself.
    Without training rows every count is zero. No rows: an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), held_out(key).alias("held_out"), text_bytes(text).alias("data"))
    learn = rows.where(~F.col("held_out"))
    counts = staged(count_tokens(learn), "lm_counts").withColumn("grade", F.floor(F.log2("c") * 8))
    grades = counts.groupBy("grade").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).orderBy(F.desc("grade")).collect()  # 8 per doubling of a count
    total, distinct = sum(r["n"] for r in grades), sum(r["v"] for r in grades)
    size, least = 0, math.inf
    for r in grades:
        if (size := size + r["v"]) > HEAD:
            break
        least = r["grade"]
    words = min(MOST - 64, max(FEWEST, math.isqrt(distinct)))
    top = counts.where(F.octet_length("token") > 0).orderBy(F.desc("c"), "token").limit(words).collect()
    classes = {bytes(r["token"]): i + 2 for i, r in enumerate(top)} | {END: STOP}
    head = {bytes(r["token"]): r["c"] for r in counts.where(F.col("grade") >= least).select("token", "c").collect()} if grades and least < math.inf else {}
    head |= {bytes(r["token"]): r["c"] for r in top}
    ends = counts.where(F.octet_length("token") == 0).agg(F.sum("c")).first()[0] or 0
    # classes of head tokens of like frequency: one for each doubling of the count
    size_of, types_of = [0, ends, *[r["c"] for r in top]], [0, 1, *[1 for _ in top]]
    bins: dict[int, int] = {}
    for token, c in head.items():
        if token not in classes:
            i = bins.setdefault(c.bit_length(), len(size_of))
            if i == len(size_of):
                size_of.append(0)
                types_of.append(0)
            classes[token] = i
            size_of[i] += c
            types_of[i] += 1
    known, types = np.array(size_of, dtype=np.float64), np.array(types_of, dtype=np.float64)
    known[RARE], types[RARE] = total - known.sum(), distinct - (types.sum() if ends else types.sum() - 1)
    start = start_model(known)
    noise = (known + 0.5) / (known + 0.5).sum()
    within = np.log10(np.array([*head.values(), 0.0]) + 0.5)  # of its class, but for single tokens
    number = np.array([classes[w] for w in head] + [RARE])
    single = types[number] == 1
    within_class = np.where(single | (number == RARE), 0.0, within - np.log10(np.maximum(known[number] + 0.5 * types[number], 0.5)))
    model = start
    if total:
        shards = max(1, round(total / SHARD_TOKENS))
        shared = spark.sparkContext.broadcast((classes,))
        dealt = _shards(learn, shared, shards)
        model = _trained(dealt, start, noise, shards, max(1.0, min(20.0, _LEAST_TOKENS / max(1, total))))
        discard(dealt)
    shared = spark.sparkContext.broadcast((classes, {w: i for i, w in enumerate(head)}, within, within_class, tuple(x.astype(np.float32) for x in log_tables(model))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, head, logc, within, (s1, s2, z) = shared.value
        rid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out, tokens, times, ends = [], [], [], [0]
                for data in batch.column("data"):
                    data = data.as_py()
                    w = np.concatenate([[STOP, STOP], class_ids(data, classes)]).astype(np.int64)
                    a, b, w = w[:-2], w[1:-1], w[2:]
                    lp = float((s1[a, w] + s2[b, w] - z[a, b]).sum(dtype=np.float64)) / math.log(10)
                    bag = Counter()
                    for words in word_blocks(data):
                        bag.update(words)
                    bag[END] = 1
                    where = np.array([head.get(x, -1) for x in bag], dtype=np.int64)
                    n = np.fromiter(bag.values(), dtype=np.int64, count=len(bag))
                    here = where >= 0
                    lc = n * logc[where]
                    tokens += [x for x, i in zip(bag, where.tolist(), strict=True) if i < 0]
                    times.append(n[~here])
                    ends.append(len(tokens))
                    out.append((rid, len(w), int(n[here].sum()), float(lc[here].sum()), float((n * within[where])[here].sum()), int((w == RARE).sum()), lp))
                    rid += 1
                cols = list(zip(*out, strict=True))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times) if times else [], pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), batch.column("doc_id").cast(pa.string()), batch.column("held_out"), *[pa.array(c, t) for c, t in zip(cols[1:], [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()], strict=True)], *lists], schema=_TAIL)

    done = staged(rows.mapInArrow(score, _TAIL_DDL), "lm_rows")
    tail = done.where(F.size("token") > 0).select("rid", F.inline(F.arrays_zip("token", "times")))
    lc = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    looked = (
        tail.join(counts.where(F.col("grade") < least).select("token", "c") if least < math.inf else counts.select("token", "c"), "token", "left")
        .groupBy("rid").agg(F.sum(F.col("times") * lc).alias("tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"))
    )
    tail_sum = F.coalesce("tail", F.lit(0.0))
    per_token = math.log10(total + 0.5 * (distinct + 1))
    per_rare = math.log10(max(known[RARE], 0) + 0.5 * (max(types[RARE], 0) + 1))
    return done.drop("token", "times").join(looked, "rid", "left").select(
        F.col("doc_id").cast("long"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head") + tail_sum - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("classes") + F.col("head_rare") + tail_sum - F.col("n_rare") * per_rare).alias("score"),
    )
