"""Models behind protocols: what is available is used, batches go in, vectors and scores come out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import backends
from tessera.operators import retrieval


def test_fall_back_and_unit_vectors(spark):
    neural = backends.NeuralEmbedder("some-model")
    found = backends.chosen(neural, backends.HashEmbedder())
    assert found.name == ("some-model" if neural.available else "hash-test") and backends.chosen(None) is None
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "id int, t string").select("id", backends.vectors(F.col("t"), backends.HashEmbedder(16)).alias("v")).orderBy("id").collect()
    assert np.allclose(rows[0].v, backends.hash_embed("a b c", 16)) and np.allclose(rows[1].v, 0)


def overlap(available=True):
    class Overlap:  # within the function, so that it travels to workers by value
        """A scorer that sees all texts of a question at once."""

        name = "overlap"

        def score(self, query, texts):
            return [float(len(set(query.split()) & set(t.split()))) for t in texts]

    model = Overlap()
    model.available = available
    return model


def test_model_as_reranker(spark):
    hits = spark.createDataFrame([(1, i, 0.1, i, "T", "", t) for i, t in enumerate(["x y", "a b", "a z"], 1)], "query_id bigint, chunk_id bigint, score double, rank int, title string, heading string, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id bigint, query string")
    out = retrieval.rerank(hits, asked, overlap()).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.rerank_score) for r in out] == [(2, 2.0, 2.0), (3, 1.0, 1.0), (1, 0.0, 0.0)]
    left = retrieval.rerank(hits, asked, overlap(False)).orderBy("rank").collect()
    assert [r.chunk_id for r in left] == [1, 2, 3] and left[0].rerank_score is None


def test_dense_search_in_tiles_equals_the_plain_product(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 6)).astype(float)  # many ties
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, vec array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:20])], "query_id bigint, vec array<float>")
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in retrieval.dense_search(chunks, queries, 9).collect()}
    for q in range(20):
        want = sorted(((-float(x[q] @ x[i]), i) for i in range(300)))[:9]
        assert [got[q, k + 1] for k in range(9)] == [(i, -s) for s, i in want]


def test_placement():
    assert backends.placement({"name": "m", "size": 4_000_000, "size_vram": 1_000_000}) == {"name": "m", "bytes": 4_000_000, "gpu_percent": 25.0}
    assert backends.placement({"name": "m"})["gpu_percent"] == 0.0 and backends.megabytes(1_250_000) == pytest.approx(1.2, abs=0.11)
    with pytest.raises(backends.ModelError):
        backends.Http("http://127.0.0.1:9").tags()
