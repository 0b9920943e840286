from types import SimpleNamespace

import numpy as np
import pandas as pd

from kairograph import storage
from kairograph.operators import keyword_index, retrieval, vector_index


def test_blocks_without_bounds_hold_none_and_answer_like_a_scan(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i} c{i}") for i in range(300)] + [(300, None), (301, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b3"), (2, "c17 b1"), (3, "zz")], "item_id long, text string")
    path = storage.shared_path(spark, "words")
    keyword_index.add(docs, path, "all")
    blocks = keyword_index.postings(spark, path, ["a", "b3", "c17"])
    assert blocks.count() > 2 and blocks.where("size(low) > 0 or size(high) > 0").count() == 0
    assert blocks.where("n <> size(doc_id) or n <> size(len)").count() == 0
    rows = lambda f: sorted(tuple(r) for r in f.select("item_id", "doc_id", "score", "rank").collect())
    assert rows(keyword_index.search(spark, path, asked, 5)) == rows(retrieval.bm25(docs, asked, 5))


def test_distances_to_many_pivots_are_held_in_slices(monkeypatch):
    held, plain = [], vector_index._distances
    monkeypatch.setattr(vector_index, "CELLS", 5000, raising=False)
    monkeypatch.setattr(vector_index, "_distances", lambda x, y: held.append(len(x) * len(y)) or plain(x, y))
    draw = np.random.default_rng(1)
    pivots = vector_index._unit(draw.normal(size=(900, 4)))
    batch = pd.DataFrame({"vec_id": range(300), "embedding": list(draw.normal(size=(300, 4)))})
    got = pd.concat(vector_index._deal(SimpleNamespace(value=pivots))(iter([batch])))
    assert got["vec_id"].tolist() == list(range(300)) and max(held) <= 5000
    assert np.array_equal(got["cell"], plain(vector_index._unit(batch["embedding"]), pivots).argmin(axis=1))
