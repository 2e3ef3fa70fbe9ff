"""Retrieval quality of ranked results against expected passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window  # noqa: F401  the command line numbers questions
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))


def ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, needle, rank): the best rank at which a result has the passage, null if none does.

    ``results`` has query_id, rank, text; ``expected`` query_id, expect. The passage is only looked for in its own query's results."""
    found = expected.select("query_id", "expect").join(results.select("query_id", "rank", "text"), "query_id", "left")
    hit = F.contains(plain(F.col("text")), plain(F.col("expect")))
    return found.groupBy("query_id", F.col("expect").alias("needle")).agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))


def scores(found: DataFrame, results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hit@1, hit@3, hit@5, MRR (0 for a miss), coverage, misses, mean results; one row, or one for each group."""
    by = by or []
    best = found.groupBy(*by, "query_id").agg(F.min("rank").alias("rank"), F.count("rank").alias("n_found"), F.count("*").alias("n_wanted"))
    returned = results.groupBy(*by, "query_id").agg(F.count("*").alias("n_returned"))
    hit = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)).alias(f"hit_{n}")
    return best.join(returned, [*by, "query_id"], "left").groupBy(*by).agg(
        hit(1), hit(3), hit(5), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), (F.sum("n_found") / F.sum("n_wanted")).alias("coverage"),
        F.count_if(F.col("rank").isNull()).alias("misses"), F.avg(F.coalesce("n_returned", F.lit(0))).alias("returned"),
    )


def query_source(lines: DataFrame) -> DataFrame:
    """(query, expect array) from JSON lines in ``value``; blank lines and comments are passed over, one passage may be bare."""
    rows = lines.where((F.btrim("value") != "") & ~F.col("value").startswith("#"))
    both = rows.select(
        F.get_json_object("value", "$.query").alias("query"),
        F.from_json(F.get_json_object("value", "$.expect"), "array<string>").alias("many"),
        F.get_json_object("value", "$.expect").alias("one"),
    )
    return both.select("query", F.when(F.col("one").startswith("["), F.col("many")).otherwise(F.array("one")).alias("expect"))
