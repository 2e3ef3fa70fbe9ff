"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import format_automata, heap_lloyd, html_text, licence_index, mixing, multiset_hash, ngram_ratio, packing, rule_ensemble, simhash, sort_means, suffix_tree, urls, vector_sql
from tessera.llm.oracles import ORACLES


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of each url; empty where they say nothing."""
    said = urls.op1(spark, sf_dir)
    return said.select("page_id", "host", "path", F.coalesce("rule", F.lit("")).alias("rule"), F.when(F.col("rule").isNotNull(), F.col("verdict")).otherwise("").alias("verdict"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.op4(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_automata.op8(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_ratio.op10(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that name a licence wherever they stand; places are -1 where there are none."""
    place = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    return licence_index.op11(spark, sf_dir).select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": urls.op1,
        "op2_lm_score": suffix_tree.op2,
        "op3_simhash": simhash.op3,
        "op4_fingerprints": multiset_hash.op4,
        "op5_mixing": mixing.op5,
        "op6_html_text": html_text.op6,
        "op7_quality": rule_ensemble.op7,
        "op8_secrets": format_automata.op8,
        "op9_packing": packing.op9,
        "op10_quality_rules": ngram_ratio.op10,
        "op11_license_scan": licence_index.op11,
        "op12_vector_codes": heap_lloyd.op12,
        "op13_centroids": sort_means.op13,
        # parts of these that SQL can express
        "url_rules": url_rules,
        "edited_texts": edited_texts,
        "secret_counts": secret_counts,
        "rule_counts": rule_counts,
        "license_words": license_words,
    }


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op12_vector_codes": vector_sql.heap_lloyd(), "op13_centroids": vector_sql.sort_means()}
