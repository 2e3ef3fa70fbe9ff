"""Exact search over cells against all products, and recall of many campaigns against one campaign at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, recall, retrieval

VECTORS = "chunk_id bigint, vec array<float>"


def clustered(spark, n=600, dims=8, spread=0.05):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, dims)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rnd.normal(size=dims) * spread]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, [0.0] * dims)], VECTORS), rows


@pytest.mark.parametrize(("k", "block"), [(5, 1024), (1000, 16), (30, 8)])
def test_cells_give_what_all_products_give(spark, monkeypatch, k, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    index, rows = clustered(spark)
    queries = spark.createDataFrame([(i, v) for i, v in rows[:9]] + [(100, None), (101, [0.0] * 8), (102, [-1.0] * 8)], "query_id bigint, vec array<float>")
    search = cells.CellSearch(cells.build(index, 20), queries, k)
    got = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in search.found.collect())
    assert got == sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in retrieval.dense_search(index, queries, k).collect())


def test_more_queries_than_travel_at_once_are_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 40)
    index, rows = clustered(spark)
    queries = spark.createDataFrame([*rows[:90], (900, None)], "query_id bigint, vec array<float>")
    plain = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())
    found = plain(cells.CellSearch(cells.build(index, 20), queries, 7).found)
    assert len(found) == 90 * 7 and found == plain(retrieval.dense_search(index, queries, 7))


def test_blocks_beyond_the_threshold_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    index, rows = clustered(spark, spread=0.01)
    search = cells.CellSearch(cells.build(index, 24), spark.createDataFrame(rows[:6], "query_id bigint, vec array<float>"), 5)
    share = search.share().first()
    assert share.n_read < 0.7 * share.n_blocks


def test_a_cell_with_most_vectors_is_divided_and_sizes_must_fit(spark):
    same = spark.range(5_000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vec"))
    blocks = cells.build(same, 4)
    assert blocks.agg(F.max(F.size("chunk_ids"))).first()[0] <= cells.BLOCK
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vec array<float>")
    assert [r.chunk_id for r in cells.CellSearch(blocks, asked, 3).found.orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="reindex"):
        cells.CellSearch(blocks, spark.createDataFrame([(1, [1.0])], "query_id bigint, vec array<float>"), 3).found.collect()
    for b, q in ((cells.build(same.limit(0)), asked), (blocks, asked.limit(0))):
        assert cells.CellSearch(b, q, 3).found.count() == 0


def test_each_campaign_recalls_its_own(spark):
    rows = [("a", 1, "fact", "the old mill by the river"), ("a", 2, "event", "a boat on the river Rhine"), ("a", 3, "", "nothing of note"), ("b", 1, "fact", "the river is dry"), ("b", 2, None, None), ("c", 1, "fact", "the mill burns, e-4471")]
    rows += [("hot", i, "fact", f"river number {i % 7} and mill {i % 3}") for i in range(300)]
    memories = spark.createDataFrame(rows, "campaign string, chunk_id bigint, heading string, text string")
    questions = spark.createDataFrame([("a", "river mill"), ("b", "river mill"), ("c", "what of E-4471"), ("hot", "river number 3"), ("none", "river"), ("c2", "")], "campaign string, query string")
    got = {(r.campaign, r.rank): (r.chunk_id, round(r.score, 6)) for r in recall.bm25_by_group(memories, questions, 5).collect()}
    want = {}
    for name, text in (("a", "river mill"), ("b", "river mill"), ("c", "what of E-4471"), ("hot", "river number 3")):
        own = memories.where(F.col("campaign") == name).select("chunk_id", "heading", "text")
        for r in retrieval.bm25_search(own, spark.createDataFrame([(1, text)], "query_id bigint, query string"), 5).collect():
            want[name, r.rank] = (r.chunk_id, round(r.score, 6))
    assert got == want
    vec = F.array(F.lit(1.0), F.col("chunk_id").cast("double"))
    both = recall.recall_by_group(memories.withColumn("vec", vec), questions.withColumn("vec", F.array(F.lit(1.0), F.lit(1.0))), 3)
    assert {r.campaign for r in both.collect()} == {"a", "b", "c", "hot"} and both.where("campaign = 'a'").count() == 3
    lines = {r.campaign: r.lines for r in recall.recalled_lines(memories, both.where("campaign = 'a'"), 20).collect()}
    assert list(lines) == ["a"] and len(lines["a"].split("\n")) == 1
