"""A corpus pipeline over ``documents``: quality, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import format_automata, mixing, near_copies, packing, rule_ensemble
from tessera.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labels, rejects go; null and empty texts are judged like others."""
    return rule_ensemble.kept(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")), COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles alike to 0.8 or more, stays: the smallest id. Null and
    empty texts are alike; of a group without ids each text stays once."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows. All rows stay; a null text stays null."""
    from pyspark.sql import functions as F

    clean = format_automata.redacted(docs.select(*COLUMNS), format_automata.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; none that is clean is lost. Rows that are alike fare alike."""
    return mixing.mixed(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is its end token."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: Learnt models decide in two stages, and a tokenizer in the last; the rows are held against a plain version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
