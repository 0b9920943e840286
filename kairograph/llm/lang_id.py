"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are made by Spark: each task turns its texts into counts of
(language, bucket), which are summed by key. The resulting log-probability
matrix has (number of languages) x ``BUCKETS`` cells whatever the corpus, and
is broadcast. Scoring multiplies each Arrow batch, as a sparse matrix of texts
and buckets in CSR form, with that matrix in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Expected number of training rows per language; the classifier is fitted on
#: this bounded sample of the labelled rows, drawn by a hash of the row key.
TRAIN_ROWS_PER_LANG = 4000
ALPHA = 0.5
BLOCK = 1 << 16  # characters that are hashed at once
#: Languages whose matrix (256 KB each) is broadcast at once; more are gone through in blocks.
LANG_BLOCK = 256
#: Languages (some 30 bytes each) whose counts are broadcast; more are joined.
BROADCAST_LANGS = 100_000

_LETTER = re.compile(r"[^\W\d_]")
_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def csr(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse matrix of texts and buckets, in parts of about BLOCK n-grams of each order.

    A part is ``rows, starts, indices``: the buckets ``indices[starts[i]:starts[i+1]]``, repeats
    included, are of text ``rows[i]``; none is empty. A long text has rows in several parts.
    """
    most = max(ORDERS) - 1
    held: list[tuple[int, str, int]] = []  # text, characters, how many n-grams may start in them
    size = 0

    def flush():
        owner = np.array([x[0] for x in held])
        lengths = np.array([len(x[1]) for x in held])
        part = np.repeat(np.arange(len(held)), lengths)
        place = np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        own = place < np.array([x[2] for x in held])[part]
        c = np.frombuffer("".join(x[1] for x in held).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for n in ORDERS:
            if len(c) >= n:
                h = np.zeros(len(c) - n + 1, dtype=np.uint32)
                for k in range(n):
                    h = (h ^ c[k : k + len(h)]) * _MULT[k]
                use = own[: len(h)] & (place[: len(h)] + n <= lengths[part[: len(h)]])
                at = part[: len(h)][use]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                if len(at):
                    yield owner[at[starts]], starts, ((h[use] ^ (h[use] >> np.uint32(15)) ^ np.uint32(n * 0x9E37)) * _MULT[0] >> np.uint32(16)).astype(np.int32)

    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        for at in range(0, len(text), BLOCK):
            held.append((i, text[at : at + BLOCK + most], min(BLOCK, len(text) - at)))
            size += held[-1][2]
            if size >= BLOCK:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            row = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for _, _, indices in csr(texts.tolist()):
                row += np.bincount(indices, minlength=BUCKETS)
    for lang, row in counts.items():
        used = np.flatnonzero(row)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": row[used]})


def _vector(part: pd.DataFrame) -> pd.DataFrame:
    dense = np.full(BUCKETS, ALPHA)
    dense[part["bucket"]] += part["n"]
    return pd.DataFrame({"lang": [part["lang"].iloc[0]], "logp": [(np.log(dense) - np.log(dense.sum())).astype("<f4").tobytes()]})


Model = list[tuple[list[str], np.ndarray]]


def fit(docs: DataFrame, *, rows_per_lang: int = TRAIN_ROWS_PER_LANG, key: str = "doc_id") -> Model:
    """Blocks of languages, each with the float32 matrix (BUCKETS, languages) of log-probabilities, without priors.

    Rows with a null ``text`` or ``lang`` teach nothing. No usable row: no block.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(key, "text", "lang")
    sizes = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "lang_sizes")
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), "text", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)  # by text too, as keys may be null or repeated
    sample = rows.join(few, "lang").where(draw < rows_per_lang / F.col("of"))
    counts = sample.select("lang", "text").mapInPandas(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    vectors = staged(counts.groupBy("lang").applyInPandas(_vector, "lang string, logp binary"), "lang_vectors")  # BUCKETS rows a group at most
    langs = sorted(r["lang"] for r in vectors.select("lang").collect())
    model = []
    for at in range(0, len(langs), LANG_BLOCK):
        part = langs[at : at + LANG_BLOCK]
        found = {r["lang"]: np.frombuffer(r["logp"], dtype="<f4") for r in vectors.where(F.col("lang").isin(part)).collect()}
        model.append((part, np.stack([found[x] for x in part], axis=1)))
    discard(vectors, sizes)
    return model


def totals(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Log-probability of each text in each language: the sparse matrix of the texts times ``logp``."""
    out = np.zeros((len(texts), logp.shape[1]))
    for rows, starts, indices in csr(texts):
        for at in range(0, logp.shape[1], 16):
            np.add.at(out[:, at : at + 16], rows, np.add.reduceat(logp[:, at : at + 16][indices], starts, axis=0, dtype=np.float64))
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (existing ones of these names are replaced).

    ``score`` is the posterior of the predicted language under a uniform
    prior. Null texts and texts without any letter get ``und`` and 0, and so do all if nothing was learned.
    """
    context = docs.sparkSession.sparkContext
    out = docs

    def classifier(shared):
        @F.arrow_udf("lang string, best double, rest double")
        def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            langs, logp = shared.value
            for whole in batches:
                parts = []
                for at in range(0, len(whole), 512):  # so that few texts are held as Python's strings
                    texts = whole.slice(at, 512).to_pylist()
                    use = [i for i, x in enumerate(texts) if _has_letter(x)]
                    names, best, rest = [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                    if use:
                        total = totals([texts[i] for i in use], logp)
                        best[use] = top = total.max(axis=1)
                        rest[use] = np.log(np.exp(total - top[:, None]).sum(axis=1))
                        for i, k in zip(use, total.argmax(axis=1).tolist(), strict=True):
                            names[i] = langs[k]
                    parts.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(best), pa.array(rest)], names=["lang", "best", "rest"]))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang", pa.string()), ("best", pa.float64()), ("rest", pa.float64())]))

        return classify

    hits = [f"__language{i}" for i in range(len(model))]
    for name, block in zip(hits, model, strict=True):
        out = out.withColumn(name, classifier(context.broadcast(block))(F.col(text)))
    if not hits:
        return out.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    best = F.greatest(*[F.col(f"{h}.best") for h in hits]) if len(hits) > 1 else F.col(f"{hits[0]}.best")
    lang = F.coalesce(*[F.when(F.col(f"{h}.best") == best, F.col(f"{h}.lang")) for h in hits])
    share = sum(F.exp(F.col(f"{h}.best") - best + F.col(f"{h}.rest")) for h in hits)
    return out.withColumns({"lang_pred": F.coalesce(lang, F.lit("und")), "score": F.when(lang.isNull(), 0.0).otherwise(1 / share)}).drop(*hits)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves the remainder 1 modulo 3 (null key: no)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict for every row: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
