"""Quality rules: plain counts of a text, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets, are estimated: of the trusted target (texts that ``labels.quality`` marks 1, smoothed
towards the corpus) and of the raw corpus (all texts). A text's score is the mean of log(target / raw) over its n-grams; it is kept if the score
is at least the threshold, with no chance involved.

DataFrame functions only. Scale: one exchange of BUCKETS rows for each task, after partial sums; the ratio table has
BUCKETS entries whatever the corpus and travels with the plan. The rules need no exchange at all.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, labelled_sample, only, table

BUCKETS = 65_536
#: At most so many labelled texts stand for the trusted target.
TRUSTED = 20_000
#: Counts by which the target is smoothed towards the corpus.
PRIOR = 8 * BUCKETS
#: A text whose n-grams are on average this much less likely in the target than in the corpus (log ratio) goes. Smoothing by
#: PRIOR draws all ratios to 0, the more the smaller the target; they are divided by the target's weight against it, so that
#: the threshold means the same at every size.
THRESHOLD = -0.12
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: inside a lambda an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(hashes: Column) -> Column:
    """How many words lie in windows of 8 that occur twice or more, from the hashes of the words.

    Windows are compared by a 64-bit hash, made of hashes of runs of 1, 2 and 4 words. Most texts have no window twice, which one pass over
    distinct values shows; else windows are sorted by (hash, place), those with an equal neighbour are kept in order
    of place, and each covers what the one before it doesn't.
    """
    n = F.size(hashes)

    def doubled(a: Column, k: int) -> Column:
        """Hashes of runs twice as long, from those of runs of k."""
        return F.transform(F.sequence(F.lit(0), F.size(a) - k - 1), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + k)))

    windows = named(doubled(hashes, 1), lambda two: named(doubled(two, 2), lambda four: doubled(four, 4)))

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda ordered: F.transform(
            ordered,
            lambda x, k: F.when(
                (F.try_element_at(ordered, k + 2)["h"] == x["h"]) | ((k > 0) & (F.try_element_at(ordered, F.greatest(k, F.lit(1)))["h"] == x["h"])), x["i"]
            ),
        )
        places = F.array_sort(F.array_compact(named(pairs, twin)))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
            lambda s, p: F.struct((s["sum"] + F.least(F.lit(WINDOW), p - s["last"])).alias("sum"), p.alias("last")),
            lambda s: s["sum"],
        )

    count = named(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(count)


def rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with a text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    rest = F.length(t)
    for s in SYMBOLS:
        rest -= F.length(F.replace(t, F.lit(s), F.lit("")))
    symbols = rest + (len(SYMBOLS) - 1) * F.length(t)
    return (
        docs.withColumn("_words", words_of(t))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": symbols.cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeated_words(F.col("_hashes")).cast("long"),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .drop("_lines")
    )


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pair(words: Column, h: Column, i: Column) -> Column:
    """Hash of a word and the next one; the last word stands alone."""
    return F.xxhash64(h, F.get(words, i + 1))


def grams(words: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours, from the hashes of the words."""
    return F.concat(F.transform(words, _bucket), F.transform(words, lambda h, i: _bucket(_pair(words, h, i))))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) for each bucket, by the target's weight; ``docs`` has id and _hashes, ``trusted`` the ids of the target (bounded)."""
    marked = docs.join(F.broadcast(trusted.select("id").withColumn("_trusted", F.lit(1))), "id", "left")
    counts = (
        marked.select("_trusted", F.explode(grams(F.col("_hashes"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
        .collect()  # at most BUCKETS rows
    )
    raw, target = ([0] * BUCKETS for _ in range(2))
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    if not sum(target):
        return [0.0] * BUCKETS
    all_raw, all_target = sum(raw), sum(target)
    out, weight = [], all_target / (all_target + PRIOR)
    for r, t in zip(raw, target, strict=True):
        share = (r + 1) / (all_raw + BUCKETS)  # the target is smoothed towards the corpus
        out.append((math.log((t + PRIOR * share) / (all_target + PRIOR)) - math.log(share)) / weight)
    return out


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bound: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio) of every row.

    Null and empty texts have no words and fail the base rules. Without any trusted text the ratio is 0 and the base
    rules decide. Repeated rows each give a row; null ids are never trusted. An empty table gives an empty result; other
    columns are ignored. The log ratio is the mean over words and pairs, so texts of all lengths compare.
    """
    rows = only(docs, id=id_col, text=text_col)
    trusted = labelled_sample(labels.where("quality = 1"), "quality", bound, held_out=None)
    hashed = rows.select("id", F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("_hashes"))
    ratios = F.from_json(F.lit(json.dumps(log_ratios(hashed, trusted))), "array<double>")  # folded to one literal
    ratio = lambda s, b: s + F.get(ratios, b)
    mean = F.aggregate(grams(F.col("_hashes")), F.lit(0.0), ratio) / F.greatest(2 * F.size("_hashes"), F.lit(1))
    out = rules(rows).withColumn("log_ratio", mean)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
