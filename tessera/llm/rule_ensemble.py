"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on the statistics of a bounded sample of labelled texts; each path from a root is a rule, a
conjunction of bounds on statistics. A logistic model over all rules is fitted with an L1 penalty, which leaves few of
them; these are compiled into one Spark column expression, so that the score of a text is readable as a sum of rules.

Scale: no exchange of texts; the statistics of at most ``LABELLED`` texts reach the driver, the model is a column
expression of at most ``RULES`` terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, only, remainder5, small_batches, table
from tessera.llm.trees import boost, sigmoid

#: At most so many labelled texts are learnt from, those whose ids have the smallest hashes.
LABELLED = 8_000
#: Rules with the largest weights that are kept after the fit.
RULES = 60
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "word_length", "symbols", "bangs", "bars", "capitals", "digits", "stops", "commas", "foreign", "line_length",
    "lines_repeated", "words_distinct", "word_top", "short_words", "odd_ends", "runs_repeated",
)

_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&<>@^~\\{}[]_=+", bytes(range(65, 91)), b"0123456789"
_FOREIGN = bytes(range(128, 256))
_ENDS = set(b"#*$%&|<>!")


def statistics(text: str | None) -> tuple[float, ...]:
    """STATISTICS of one whole text; zeros without words."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return (0.0,) * len(STATISTICS)
    without = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    return (
        math.log1p(n), sum(map(len, words)) / n, without(_SYMBOLS), raw.count(b"!") / n, raw.count(b"|") / n, without(_CAPITALS), without(_DIGITS),
        raw.count(b".") / n, raw.count(b",") / n, without(_FOREIGN), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(kinds) / n,
        max(kinds.values()) / n, sum(len(w) < 4 for w in kinds) / len(kinds), sum(w[-1] in _ENDS for w in words) / n,
        1 - len(pairs) / (n - 1) if n > 1 else 0.0,
    )


def _statistics(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, which holds the text, and the statistics."""
    for whole in chunks:
        for first in range(0, whole.num_rows, 500):
            batch = whole.slice(first, 500)
            found = [statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            own = list(range(batch.num_columns - 1))
            yield pa.record_batch(
                [batch.column(k) for k in own] + [pa.array(c, pa.float64()) for c in zip(*found, strict=True)],
                names=[batch.schema.names[k] for k in own] + list(STATISTICS),
            )


def with_statistics(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` with the last one, the text, replaced by its statistics."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_statistics, f"{kept}, {', '.join(f'{s} double' for s in STATISTICS)}")


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    start: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score, 0 to 1, as an expression over columns named as STATISTICS."""
        total = F.lit(self.start)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, at_most, cut in rule:
                s = F.col(STATISTICS[f])
                holds = holds & (s <= cut if at_most else s > cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(35.0)), F.lit(-35.0))))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for rule, weight in self.rules:
            total += weight * _holds(rule, x)
        return sigmoid(total)

    def __str__(self) -> str:
        said = [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'<=' if low else '>'} {c:.4g}" for f, low, c in r) for r, w in self.rules]
        return "\n".join([f"{self.start:+.3f}", *said])


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, at_most, cut in rule:
        out &= x[:, f] <= cut if at_most else x[:, f] > cut
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the intercept, by accelerated proximal gradients."""
    n, k = z.shape
    full = np.concatenate([np.ones((n, 1)), z], axis=1)
    v = np.ones(k + 1)
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(float(v @ (full.T @ (full @ v))), 1e-9)
    w = np.zeros(k + 1)
    u, t = w.copy(), 1.0
    for _ in range(steps):
        new = u - step * (full.T @ (sigmoid(full @ u) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, *, penalty: float = 5e-4, most: int = RULES) -> Ensemble:
    """Trees, their paths as rules, sparse weights. With fewer than two classes the score is the constant share."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Ensemble(math.log(share / (1 - share)), [])
    model = boost(x, y, trees=30, depth=3, rate=0.25, least=max(5.0, len(y) / 500))
    rules: dict[bytes, Rule] = {}
    for tree in model.trees:
        for path in tree.paths():
            holds = _holds(tuple(path), x)
            if 0 < holds.sum() < len(y):
                rules.setdefault(holds.tobytes(), tuple(path))  # of rules that say the same, the first
    listed = list(rules.values())
    if not listed:
        return Ensemble(model.start, [])
    z = np.stack([_holds(r, x) for r in listed], axis=1).astype(float)
    start, weights = lasso(z, y, penalty)
    chosen = np.nonzero(weights)[0]
    if len(chosen) > most:
        chosen = np.sort(chosen[np.argsort(-np.abs(weights[chosen]), kind="stable")[:most]])
        start, kept = lasso(z[:, chosen], y, penalty)
    else:
        kept = weights[chosen]
    return Ensemble(start, [(listed[i], float(w)) for i, w in zip(chosen, kept, strict=True) if w])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED, held_out: int | None = 0) -> Ensemble:
    """Learn ``labels.quality`` from at most ``bound`` texts; ids whose crc32 mod 5 is ``held_out`` are never used."""
    sample = labelled_sample(labels, "quality", bound, held_out=held_out)
    marked = only(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id").select("id", "label", "text")
    # one row for each id, however often it is in the table: the one with the least statistics
    found = with_statistics(marked).groupBy("id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("id", "label", "s.*").orderBy("id").toPandas()
    return fit(found[list(STATISTICS)].to_numpy(dtype=float).reshape(-1, len(STATISTICS)), (found["label"] > 0).to_numpy(dtype=float))


def score(docs: DataFrame, model: Ensemble, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have all statistics 0 and are scored like any other. Repeated rows each give a row; a null id
    counts as the empty text in crc32. An empty table gives an empty result; other columns are ignored. Labels of ids
    that no document has, null labels and null ids are not used; an id with two labels counts as the lower one.
    """
    rows = with_statistics(only(docs, id=id_col, text=text_col))
    out = rows.select(F.col("id").alias(id_col), (remainder5("id") == 0).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept(docs: DataFrame, model: Ensemble, names: Sequence[str]) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with the columns ``names``.

    Null and empty texts have all statistics 0 and are judged like others; repeated rows are judged alike; a null id is no
    matter. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    rows = with_statistics(docs.select(*names, F.col("text").alias("_text")))
    return rows.where(model.column() >= THRESHOLD).select(*names)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
