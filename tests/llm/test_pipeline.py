"""Every stage of the corpus pipeline, on its own input, against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kairograph.llm import simhash_dedup

from .test_llm import DOCS, brute_components


def say(draw, letters, n):
    return " ".join("".join(draw.choice(letters) for _ in range(6)) for _ in range(n))


def test_stages_match_plain_versions(spark, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    draw = random.Random(12)
    letters = ["abcdefgh", "pqrstuvw"]
    texts = [". ".join(say(draw, letters[i % 2], 12) for _ in range(4)) + "." for i in range(60)]
    passage = ". ".join(say(draw, letters[0], 9) for _ in range(9)) + "."
    texts += [f"{say(draw, letters[0], 20)}. {passage} {say(draw, letters[0], 20)}." for _ in range(4)]
    line = say(draw, letters[1], 8)  # too short for a chunk, so that copies reach the near-duplicate stage
    texts += [line, line.upper(), line]
    item = say(draw, letters[0], 25)
    texts += [f"{say(draw, letters[0], 30)} {item} {say(draw, letters[0], 30)}", None, "", "12 34 56"]
    docs = spark.createDataFrame([(i, t, ["one", "two"][i % 2] if i < 60 else None, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, df = rows(docs), docs
    whole = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        if name == "packing":
            got = {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
            assert got == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in before.items()}
            assert df.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
            break
        df = df.cache()
        assert df.columns == docs.columns and df.count() == len(after := rows(df))
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            parts = passage.removesuffix(".").split(". ")
            assert set(after) == set(before) and all(after[i] == before[i] for i in after if not 60 < i < 64)
            assert not any(p in after[i] for i in (61, 62, 63) for p in parts)
            assert all(r["n_chars"] == len(r["text"]) for r in df.collect())
        elif name == "simhash_dedup":
            ids, prints = list(before), {i: int.from_bytes(simhash_dedup.simhash(t.encode()), "big") for i, t in before.items()}
            root = brute_components(ids, lambda i, j: (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 2)
            assert after == {i: t for i, t in before.items() if root[i] == i} and not {65, 66} & set(after)
        else:
            assert after == {i: t for i, t in before.items() if item not in t} and len(after) < len(before)
        before = after


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, columns with clashing names, no n_chars; and no rows at all."""
    pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    draw = random.Random(13)
    texts = [". ".join(say(draw, "abcdefgh", 12) for _ in range(3)) for _ in range(12)]
    rows = [(i, t, "one", "s", "x", "y", "z") for i, t in enumerate(texts)] + [(3, texts[3], "one", "s", "x", "y", "z"), (None, texts[4], None, None, None, None, None), (50, None, None, None, None, None, None), (51, "", "one", "s", "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, removed string, score string, component_id string")
    spark.createDataFrame([(1, "never seen words here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path)).cache()
            if name != "packing":
                assert df.columns == docs.columns and [t for _, t in df.dtypes] == [t for _, t in docs.dtypes]
            if name == "simhash_dedup":
                ids = sorted(r["doc_id"] for r in df.collect())
                assert ids == sorted(set(ids)) and (not ids or set(range(12)) <= set(ids))
        assert df.count() == 0 or df.agg(F.count_distinct("doc_id")).first()[0] == 12


def test_near_duplicates_go_by_row(spark):
    draw = random.Random(31)
    t, u = (" ".join(f"w{draw.randrange(500)}" for _ in range(60)) for _ in range(2))
    docs = lambda rows: spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], DOCS)
    kept = lambda rows: sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs(rows), "").collect()), key=str)
    assert kept([(1, t), (None, t), (None, u)]) == sorted([(1, t), (None, u)], key=str)
    assert kept([(None, t), (None, t), (2, u), (2, u), (2, t)]) == sorted([(2, t), (2, u)], key=str)
    assert kept([(3, t), (3, u), (4, t)]) == sorted([(3, t), (3, u)], key=str)
    assert kept([(5, t), (4, t), (6, u)]) == sorted([(4, t), (6, u)], key=str)
