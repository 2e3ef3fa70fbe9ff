"""Mixing to target weights with soft membership.

A multinomial logistic model, learnt from a bounded sample of the table ``labels``, gives each document a posterior over
three domains: clean, poor (quality 0) and toxic. Document rates are then fitted so that the expected tokens of each
domain meet their targets: least squares over the domains' relative gaps, by projected gradients, rates never below zero nor, where clean documents are to be kept, below one for a document that is clean with a posterior of
1/2 or more. All documents start at rate 1, and steps lie in the span of the posteriors, so the fit changes rates as
little as it must. The gradient of a step is scaled by the curvature over the documents that are off their bounds, and is
halved if it would not bring the totals nearer. The fit says what it reached.

Scale: a step is one aggregation to as many numbers as there are domains. A document's rate is a function of its
posterior and of the steps so far, so no rates are stored or joined between steps. There is no exchange of documents.
Features, not texts, of the labelled sample reach the driver: at most LABELLED rows of some 200 numbers.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, labelled_sample, materialise, only, table
from tessera.llm.rule_ensemble import STATISTICS, statistics

DOMAINS = ("clean", "poor", "toxic")
#: Shares of the tokens that the domains should have.
TARGETS = (0.90, 0.08, 0.02)
#: At most so many labelled texts are learnt from, those whose ids have the smallest hashes.
LABELLED = 6_000
#: Words per domain that the classifier looks for.
WORDS = 64
STEPS, CLOSE = 40, 1e-4


def _bag(text: str | None) -> set[bytes]:
    return {w.strip(b".,;:!?\"'()[]") for w in (text or "").encode().lower().split()}


@dataclass
class Posterior:
    """Soft membership in DOMAINS."""

    words: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (1 + statistics + words) x domains

    def design(self, raw: np.ndarray) -> np.ndarray:
        """Raw features with an intercept, and the statistics brought to one scale."""
        x = np.concatenate([np.ones((len(raw), 1)), raw], axis=1)
        k = 1 + len(self.mean)
        x[:, 1:k] = np.clip((x[:, 1:k] - self.mean) / self.scale, -5, 5)
        return x

    def of(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(DOMAINS)))
        return _softmax(self.design(raw_features(texts, self.words)) @ self.weights)


def raw_features(texts: list[str | None], words: dict[bytes, int]) -> np.ndarray:
    """The statistics of each text, and which of the words it has."""
    k = len(STATISTICS)
    x = np.zeros((len(texts), k + len(words)))
    for i, t in enumerate(texts):
        x[i, :k] = statistics(t)
        for w in _bag(t) & words.keys():
            x[i, k + words[w]] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def choose(counts: dict[bytes, np.ndarray], sizes: np.ndarray, most: int = WORDS) -> list[bytes]:
    """The words that mark each domain: in how much larger a share of its texts than of others, as a signed chi-square root."""
    n, chosen = sizes.sum(), []
    for d in range(len(DOMAINS)):
        def gain(w: bytes, d: int = d) -> float:
            a, all_ = counts[w][d], counts[w].sum()
            m = all_ / max(n, 1)
            return (a / max(sizes[d], 1) - (all_ - a) / max(n - sizes[d], 1)) / math.sqrt(m * (1 - m) + 1e-9) * math.sqrt(sizes[d])

        chosen += sorted((w for w, c in counts.items() if c[d] >= 5), key=lambda w: (-gain(w), w))[:most]
    return list(dict.fromkeys(chosen))


def learn(raw: np.ndarray, domain: np.ndarray, words: list[bytes], *, steps: int = 300, ridge: float = 1e-3) -> Posterior:
    """Fit to raw features of texts of known domains; with none, every posterior is flat."""
    n, k, p = len(raw), len(DOMAINS), len(STATISTICS)
    index = {w: i for i, w in enumerate(words)}
    mean = raw[:, :p].mean(axis=0) if n else np.zeros(p)
    scale = raw[:, :p].std(axis=0) + 1e-6 if n else np.ones(p)
    model = Posterior(index, mean, scale, np.zeros((1 + p + len(index), k)))
    if not n:
        return model
    x, y = model.design(raw), np.eye(k)[domain]
    step = 4.0 / (np.linalg.norm(x, ord=2) ** 2 / n)
    w = model.weights
    u, t = w.copy(), 1.0
    for _ in range(steps):
        grad = x.T @ (_softmax(x @ u) - y) / n + ridge * np.vstack([np.zeros((1, k)), u[1:]])
        new = u - step * 0.5 * grad
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    model.weights = w
    return model


def _word_counts(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label, n) of rows (id, label, text): how many texts have a word."""
    counts: Counter[tuple[bytes, int]] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.record_batch([pa.array([w for w, _ in counts], pa.binary()), pa.array([d for _, d in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "label", "n"])
        counts.clear()
        return rows

    for batch in chunks:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            counts.update((w, label) for w in _bag(text.as_py()))
            if len(counts) > 400_000:
                yield out()
    if counts:
        yield out()


def _features(words: dict[bytes, int]):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            x = raw_features(batch.column(2).to_pylist(), words)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED, words: int = WORDS) -> Posterior:
    """Learn from at most ``bound`` labelled ids. A toxic text is toxic whatever its quality.

    An id that is in the table more than once counts with the row of the least features, and its words once for each row."""
    marked = labels.withColumn("_domain", F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality").isNotNull(), 1))
    sample = labelled_sample(marked, "_domain", bound, held_out=None)
    found = only(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id").select("id", F.col("label").cast("int").alias("label"), "text")
    kind = found.schema["id"].dataType.simpleString()
    sizes = np.zeros(len(DOMAINS))
    for row in found.groupBy("label").agg(F.count("*").alias("n")).collect():
        sizes[row.label] = row.n
    seen = found.mapInArrow(_word_counts, "word binary, label int, n long").groupBy("word", "label").agg(F.sum("n").alias("n"))
    wide = seen.groupBy("word").pivot("label", list(range(len(DOMAINS)))).agg(F.sum("n"))
    # the candidates of each domain by its share against the others', as Spark sees it; the exact order is the driver's
    counts: dict[bytes, np.ndarray] = {}
    share = lambda d: F.coalesce(F.col(str(d)), F.lit(0))
    every = sum((share(e) for e in range(len(DOMAINS))), F.lit(0))
    for d in range(len(DOMAINS)):
        m = every / F.lit(max(sizes.sum(), 1.0))
        gain = (share(d) / F.lit(max(sizes[d], 1.0)) - (every - share(d)) / F.lit(max(sizes.sum() - sizes[d], 1.0))) / F.sqrt(m * (1 - m) + 1e-9)
        for row in wide.where(share(d) >= 5).orderBy(F.desc(gain), "word").limit(4 * words).collect():
            counts[bytes(row["word"])] = np.array([row[str(e)] or 0 for e in range(len(DOMAINS))], dtype=float)
    chosen = choose(counts, sizes, words)
    rows = found.mapInArrow(_features({w: i for i, w in enumerate(chosen)}), f"id {kind}, label int, x array<double>")
    rows = rows.groupBy("id", "label").agg(F.min("x").alias("x")).orderBy("id").collect()  # bounded by the sample
    raw = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(STATISTICS) + len(chosen))
    return learn(raw, np.array([r.label for r in rows], dtype=np.int64), chosen)


Steps = list[np.ndarray]


def _bounds(p: np.ndarray, keep_clean: bool) -> np.ndarray:
    return (p[:, 0] >= 0.5).astype(float) * keep_clean


def _path(p: np.ndarray, steps: Steps, keep_clean: bool) -> np.ndarray:
    """Rates after the steps, each a direction in the domains."""
    least = _bounds(p, keep_clean)
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(least, r - p @ g)
    return r


@dataclass
class Fit:
    """The steps of a fit, the targets and what the rates reach: expected tokens by domain."""

    steps: Steps
    want: np.ndarray
    reached: np.ndarray
    keep_clean: bool = False

    @property
    def gap(self) -> float:
        """The largest relative distance of a domain from its target."""
        return float(np.abs(self.reached / self.want - 1).max()) if len(self.want) else 0.0

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates of documents with posteriors p."""
        return _path(p, self.steps, self.keep_clean)


def _sums(steps: Steps, keep_clean: bool):
    """Domain totals of a batch at the rates after the steps, and the products of posteriors over documents off their bounds."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            t, p = columns[0], np.stack(columns[1:], axis=1)
            r = _path(p, steps, keep_clean)
            free = t * (r > _bounds(p, keep_clean))
            sums = np.concatenate([(p * (t * r)[:, None]).sum(axis=0), ((p * free[:, None]).T @ p).ravel()])
            yield pa.record_batch([pa.array([x]) for x in sums], names=[f"s{i}" for i in range(sums.size)])

    return run


def fit(members: DataFrame, targets: tuple[float, ...] = TARGETS, *, upsample: bool = True, keep_clean: bool = False) -> Fit:
    """Rates whose expected domain tokens meet the targets; ``members`` has tokens and a column for each domain.

    Targets are shares of all tokens. Without ``upsample`` they are shares that go with the first domain's own tokens, and no
    other domain is meant to have more than it has. ``keep_clean`` keeps the rates of clean documents at 1 or more; then a
    target may be out of reach, and the gap says by how much.
    """
    k = len(DOMAINS)
    rows = members.select("tokens", *DOMAINS)

    def totals(steps: Steps) -> tuple[np.ndarray, np.ndarray]:
        size = k + k * k
        found = rows.mapInArrow(_sums(steps, keep_clean), ", ".join(f"s{i} double" for i in range(size)))
        sums = np.array([x or 0.0 for x in found.agg(*[F.sum(f"s{i}") for i in range(size)]).first()])
        return sums[:k], sums[k:].reshape(k, k)

    now, curvature = totals([])
    if now.sum() <= 0:
        return Fit([], np.zeros(0), np.zeros(0), keep_clean)
    want = np.array(targets) / sum(targets) * now.sum()
    if not upsample:
        want = np.minimum(np.array(targets) / targets[0] * now[0], now)
    want = np.maximum(want, 1e-6 * now.sum())
    loss = lambda totals_: float(((totals_ - want) ** 2 / want).sum())
    steps: Steps = []
    size = 1.0
    for _ in range(STEPS):
        if np.abs(now / want - 1).max() < CLOSE or size < 1e-3:
            break  # met, or as near as the bounds allow
        weighted = curvature / want  # rows of the curvature by the weights of the least squares
        normal = curvature @ weighted.T
        g = np.linalg.solve(normal + 1e-9 * np.trace(normal) / k * np.eye(k) + 1e-300 * np.eye(k), curvature @ ((now - want) / want)) if normal.any() else np.zeros(k)
        then, curved = totals([*steps, size * g])
        if loss(then) < loss(now) * (1 - 1e-9):
            steps.append(size * g)
            now, curvature, size = then, curved, min(1.0, 2 * size)
        else:
            size /= 4
    return Fit(steps, want, now, keep_clean)


def _posteriors(model):
    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Posterior = pickle.loads(model.value)
        for whole in chunks:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                p = own.of(texts)
                tokens = pa.array([len((t or "").encode().split()) for t in texts], pa.int64())
                keep = range(batch.num_columns - 1)
                yield pa.record_batch(
                    [batch.column(i) for i in keep] + [tokens] + [pa.array(np.ascontiguousarray(c)) for c in p.T],
                    names=[batch.schema.names[i] for i in keep] + ["tokens", *DOMAINS],
                )

    return run


def membership(docs: DataFrame, model: Posterior, **columns: str) -> DataFrame:
    """The named columns with the text, which comes last, replaced by its tokens and posteriors."""
    rows = only(docs, **columns)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_posteriors(packed), ", ".join([*kept, "tokens long", *[f"{d} double" for d in DOMAINS]]))


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(doc_id, source, n_tokens, clean, poor, toxic, rate, gap) of every row; gap is the fit's, the same in all rows.

    Tokens are words. Null and empty texts have no tokens and a posterior and rate like others; repeated rows and null ids
    each give a row. Without labels the posteriors are flat, without tokens all rates are 1. An empty table gives an
    empty result; other columns are ignored. Labels without a document, and null labels, are not used.
    """
    members = materialise(membership(docs, train(docs, labels), doc_id="doc_id", source="source", text="text"), "members")
    found = fit(members, targets)

    def rate(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            p = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3, 3 + len(DOMAINS))], axis=1)
            yield pa.record_batch([*batch.columns, pa.array(found.rates(p)), pa.array(np.full(len(p), found.gap))], names=["doc_id", "source", "n_tokens", *DOMAINS, "rate", "gap"])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    return members.mapInArrow(rate, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens long, {', '.join(f'{d} double' for d in DOMAINS)}, rate double, gap double")


def copies(p: np.ndarray, found: Fit, ids: list, texts: list) -> np.ndarray:
    """How often each document is taken: floor(rate + u), u in [0, 1) from a hash of id and text."""
    u = np.array([xxhash.xxh64_intdigest(f"{i}\n{t}".encode()) / 2**64 for i, t in zip(ids, texts, strict=True)])
    return np.floor(found.rates(p) + u).astype(np.int64)


def mixed(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says (:func:`copies`).

    No domain is meant to grow, and a document that is clean with a posterior of at least 1/2 has a rate of 1 or more: both
    are part of the fit, so that what it reaches is what the rows have in expectation. Null and empty texts have a
    posterior like others; rows of one id and text are taken alike; a null id counts as the text None in the hash. An empty
    table gives an empty result.
    """
    model = train(docs, labels)
    members = materialise(membership(docs, model, text="text"), "members")
    found = fit(members, targets, upsample=False, keep_clean=True)
    discard(members)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Posterior = pickle.loads(packed.value)
        for whole in chunks:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = batch.column(text_at).to_pylist()
                n = copies(own.of(texts), found, batch.column(id_at).to_pylist(), texts)
                yield batch.take(pa.array(np.repeat(np.arange(len(n)), n)))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
