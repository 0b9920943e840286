import random

import pytest
from pyspark.sql import functions as F

from kairograph import storage
from kairograph.operators import keyword_index, retrieval, vector_index


def said(draw, n, size=400):
    return " ".join(f"w{int(size * draw.random() ** 3)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(1)
    rows = [(i, said(draw, draw.randrange(1, 80)), float(i % 10), float(i % 10 + 5) if i % 3 else None) for i in range(2000)] + [(2000, None, None, None), (2001, "", None, None)]
    questions = [(q, said(draw, draw.randrange(1, 12)), float(q % 12) if q % 4 else None) for q in range(40)] + [(40, "nothing known", None), (41, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, low double, high double")
    return docs, spark.createDataFrame(questions, "item_id long, text string, at double")


def result(frame):
    return sorted(tuple(r) for r in frame.select("item_id", "doc_id", "score", "rank").collect())


def test_index_answers_like_a_scan_and_skips_blocks(spark, corpus):
    docs, questions = corpus
    path = storage.shared_path(spark, "words")
    keyword_index.add(docs, path, "all")
    skipped = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = result(keyword_index.search(spark, path, questions, 5, skipped=skipped))
    assert got == result(retrieval.bm25(docs, questions, 5)) and got
    seen, left_out = (a.value for a in skipped)
    assert 0 < left_out < seen
    one = [spark.sparkContext.accumulator(0) for _ in range(2)]
    rare = spark.createDataFrame([(1, "w399 w390 w0")], "item_id long, text string")
    result(keyword_index.search(spark, path, rare, 1, skipped=one))
    assert one[1].value > one[0].value / 3


def test_index_reads_the_rows_of_its_terms(spark, corpus):
    path = storage.shared_path(spark, "words")
    keyword_index.add(corpus[0], path, "all")
    rows = keyword_index.postings(spark, path, ["w0", "w7"])
    assert {r["term"] for r in rows.select("term").distinct().collect()} == {"w0", "w7"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(term, [w0,w7])" in plan.split("PushedFilters")[1][:120]


def test_batches_grow_are_done_again_and_dropped(spark, corpus):
    docs, questions = corpus
    path = storage.shared_path(spark, "words")
    assert result(keyword_index.search(spark, path, questions)) == []
    early, late = docs.where("doc_id < 1200"), docs.where("doc_id >= 1200")
    want = lambda d: result(retrieval.bm25(d, questions, 4, lower="low", upper="high", at="at"))
    got = lambda: result(keyword_index.search(spark, path, questions, 4, at="at"))
    keyword_index.add(early, path, "a", lower="low", upper="high")
    assert got() == want(early)
    keyword_index.add(late, path, "b", lower="low", upper="high")
    assert got() == want(docs)
    keyword_index.add(late, path, "b", lower="low", upper="high")
    assert got() == want(docs) and keyword_index.batches(spark, path) == ["a", "b"]
    with pytest.raises(ValueError, match="another batch"):
        keyword_index.add(docs.where("doc_id = 5"), path, "c")
    assert keyword_index.batches(spark, path) == ["a", "b"]
    keyword_index.drop(spark, path, "a")
    assert got() == want(late)


def clustered(draw, groups, each, dim=8, spread=0.02):
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [[x + draw.gauss(0, spread) for x in c] for c in centres for _ in range(each)]


def test_vector_index_answers_like_a_scan_and_skips_cells(spark):
    draw = random.Random(2)
    vectors = clustered(draw, 60, 50) + [[draw.gauss(0, 1) for _ in range(8)] for _ in range(200)] + [[1.0, 2.0, 3.0]] * 3
    rows = [(i, v, float(i % 10), float(i % 10 + 6) if i % 4 else None) for i, v in enumerate(vectors)]
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("inf")] + [1.0] * 7, [], [1e200] * 8, [1e-200] + [0.0] * 7]
    rows += [(9000 + i, v, None, None) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, low double, high double")
    queries = frame.where("vec_id % 50 = 0 or vec_id >= 3198").withColumn("at", F.col("low") + 2)
    small = frame.where("vec_id not in (9005, 9006)")
    path = storage.shared_path(spark, "vectors")
    vector_index.build(small, path, lower="low", upper="high")
    counts = [spark.sparkContext.accumulator(0) for _ in range(2)]
    asked = queries.where("vec_id not in (9005, 9006)")
    rank = lambda f: sorted(tuple(r) for r in f.select("query_id", "vec_id", "score", "rank").collect())
    assert rank(vector_index.search(spark, path, asked, 5, counts=counts)) == rank(retrieval.cosine_search(small, asked, 5))
    n = asked.where(retrieval.comparable(F.col("embedding"))).count()
    assert counts[0].value < 0.3 * n * len(vectors)
    dated = rank(vector_index.search(spark, path, asked, 5, own=True, at="at"))
    assert dated == rank(retrieval.cosine_search(small, asked, 5, own=True, lower="low", upper="high", at="at"))
    few = rank(vector_index.search(spark, path, asked.where("vec_id = 0"), 4000))
    assert len(few) == 3199 and few == rank(retrieval.cosine_search(small, asked.where("vec_id = 0"), 4000))


def test_vector_index_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    path = storage.shared_path(spark, "vectors")
    vector_index.build(empty, path)
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert vector_index.search(spark, path, one).collect() == []
    vector_index.build(one, path)
    assert vector_index.search(spark, path, one).collect() == [] and vector_index.search(spark, path, empty).collect() == []
    assert [r["vec_id"] for r in vector_index.search(spark, path, one, own=True).collect()] == [1]
