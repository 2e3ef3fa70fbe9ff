"""Retrieval of many campaigns at once: each question sees the memories of its own campaign only, by that campaign's own figures.

One plan serves all campaigns: their number of memories, mean length and document frequencies are groups of the same aggregations. A
campaign may hold a large share of all memories; joins by campaign and term are dealt further by memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval
from tessera.operators.scratch import written

#: Parts that the rows of one campaign and term are dealt to.
PARTS = 8


def dealt_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` with those of ``few`` that have its keys: the rows of one key go to PARTS tasks by a hash of ``by``, and ``few`` is repeated as often."""
    own = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    return own.join(few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*keys, "_part"]).drop("_part")


def bm25_by_group(memories: DataFrame, questions: DataFrame, k: int = retrieval.BM25_K, *, group: str = "campaign", tokens=T.index_tokens) -> DataFrame:
    """(group, chunk_id, score, rank) of one question for each group, best first, ties by id.

    ``memories`` has the group, chunk_id (distinct within its group), heading and text, ``questions`` the group and query. A group
    without memories or without a question finds nothing. Texts are read once; what is written of them is the places of their own group's terms."""
    terms = questions.select(F.col(group).alias("g"), F.explode(T.query_terms(F.col("query"))).alias("term"))
    parts = terms.select("g", "term", tokens(F.col("term")).alias("parts")).where(F.size("parts") > 0)
    wanted = parts.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("wanted"))  # at most the terms of one question
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    both = memories.select(F.col(group).alias("g"), "chunk_id", tokens(F.col("text")).alias("t"), tokens(F.col("heading")).alias("h"))
    mine = dealt_join(both, wanted, ["g"], "chunk_id")
    pick = lambda c, field: F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t, i: F.when(F.array_contains("wanted", t), F.struct(F.lit(field).alias("field"), i.alias("pos"), t.alias("token")))))
    kept = written(mine.select("g", "chunk_id", (size("t") + size("h")).alias("d"), F.concat(pick("t", "text"), pick("h", "heading")).alias("hits")), "recall")
    figures = kept.groupBy("g").agg(F.count("*").cast("double").alias("n_chunks"), F.avg("d").alias("avg_tokens"))
    each = parts.select("g", "term", F.size("parts").alias("m"), F.posexplode("parts").alias("k", "token"))
    hits = dealt_join(kept.select("g", "chunk_id", "d", F.inline("hits")), each, ["g", "token"], "chunk_id")
    start = F.when(F.col("m") > 1, F.col("pos") - F.col("k"))
    starts = hits.groupBy("g", "chunk_id", "term", "m", "d", "field", start.alias("start")).agg(F.count("*").alias("n")).where("m = 1 OR n = m")
    tf = F.sum(F.when(F.col("m") == 1, F.col("n")).otherwise(1) * F.when(F.col("field") == "heading", 2).otherwise(1))
    weighted = starts.groupBy("g", "chunk_id", "term", "d").agg(tf.alias("f"))
    df = weighted.groupBy("g", "term").agg(F.count("*").alias("df")).join(figures, "g")
    idf = F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = df.select("g", "term", "avg_tokens", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
    k1, b = retrieval.K1, retrieval.B
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("d") / F.col("avg_tokens")))
    scored = dealt_join(weighted, known, ["g", "term"], "chunk_id").groupBy("g", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
    return retrieval.top(scored, k, ["g"], F.desc("score"), F.asc("chunk_id")).withColumnRenamed("g", group).select(group, "chunk_id", "score", "rank")


def dense_by_group(memories: DataFrame, questions: DataFrame, k: int = retrieval.DENSE_K, *, group: str = "campaign") -> DataFrame:
    """(group, chunk_id, score, rank) by the dot product of each group's question with its own memories; both have vec."""
    asked = questions.where("vec IS NOT NULL").select(F.col(group).alias("g"), F.col("vec").alias("q"))
    rows = dealt_join(memories.where("vec IS NOT NULL").select(F.col(group).alias("g"), "chunk_id", "vec"), asked, ["g"], "chunk_id")
    dot = F.aggregate(F.zip_with("vec", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return retrieval.top(rows.select("g", "chunk_id", dot.alias("score")), k, ["g"], F.desc("score"), F.asc("chunk_id")).withColumnRenamed("g", group)


def recall_by_group(memories: DataFrame, questions: DataFrame, top_k: int = retrieval.TOP_K, *, group: str = "campaign", tokens=T.index_tokens) -> DataFrame:
    """(group, chunk_id, score, rank): dense and BM25 lists of every group, fused; at most ``top_k`` of a group.

    What one campaign's search does without a reranker, for all of them: where questions and memories have no vec, the BM25 list alone."""
    found = bm25_by_group(memories, questions, group=group, tokens=tokens)
    key = lambda df: df.select(F.col(group).alias("query_id"), "chunk_id", "rank")
    lists = [(key(found), 1.0)]
    if "vec" in memories.columns and "vec" in questions.columns:
        lists.insert(0, (key(dense_by_group(memories, questions, group=group)), 1.0))
    return retrieval.fuse(lists).where(F.col("rank") <= top_k).withColumnRenamed("query_id", group).select(group, "chunk_id", "score", "rank")


def recalled_lines(memories: DataFrame, ranked: DataFrame, chars: int = 2_200, *, group: str = "campaign") -> DataFrame:
    """(group, lines): what each campaign's prompt shows of what it recalled, best first, within a budget of characters.

    A line is ``heading: text``; the first is always shown, and lines stop at the first that is beyond the budget."""
    rows = ranked.join(memories.select(group, "chunk_id", "heading", "text"), [group, "chunk_id"])
    line = F.concat(F.coalesce("heading", F.lit("")), F.lit(": "), F.trim(F.coalesce("text", F.lit(""))))
    spent = F.sum(F.length("line")).over(Window.partitionBy(group).orderBy("rank"))  # at most top_k rows
    shown = rows.withColumn("line", line).withColumn("spent", spent).where((F.col("spent") <= chars) | (F.col("rank") == 1))
    return shown.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "line")))["line"], "\n").alias("lines"))
