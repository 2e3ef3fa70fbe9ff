"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds with heaps.

Vectors are cut into equal parts; each position has a codebook. A block of vectors keeps, for each position and entry, a heap of
the parts assigned to that entry. A part's key is the lower bound of its distance from any other entry less the upper bound of
the distance from its own, plus the entry's cumulative drift at that time. Drift grows in each round by the entry's own move and the
largest move of another. Only parts whose key the drift has reached are popped, and rescanned exactly against all entries;
all others are certain to be where they were, with no tie.

Scale: a round is a pass over blocks without an exchange; it gathers a count and a sum for each entry and component. A block's sums change
by the parts that moved.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vector_blocks as blocks
from tessera.llm.common import join_hot, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
RESULT = "id bigint, label string, code string, error bigint"


def scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (the lower index on ties), and how much farther the second nearest is."""
    away = parts[:, None, :] - book[None, :, :]
    d = np.einsum("ijk,ijk->ij", away, away)
    best = d.argmin(axis=1)
    own = np.take_along_axis(d, best[:, None], axis=1)[:, 0]
    np.put_along_axis(d, best[:, None], np.iinfo(np.int64).max, axis=1)
    return best, np.sqrt(d.min(axis=1).astype(float)) - np.sqrt(own.astype(float))


class Heaps:
    """What a block knows of one position: the entry of each part, and a heap (key, part) for each entry."""

    def __init__(self, entry: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.entry, self.heaps = entry, heaps

    @classmethod
    def fresh(cls, n: int, entries: int) -> Heaps:
        """All parts at the first entry, with a key that any drift has reached."""
        return cls(np.zeros(n, dtype=np.uint8), [[(-np.inf, i) for i in range(n)], *([] for _ in range(entries - 1))])

    def dump(self) -> bytes:
        items = [x for heap in self.heaps for x in heap]
        sizes = np.array([len(h) for h in self.heaps], "<i4")
        return self.entry.tobytes() + sizes.tobytes() + np.array([k for k, _ in items], "<f8").tobytes() + np.array([i for _, i in items], "<i4").tobytes()

    @classmethod
    def load(cls, raw: bytes, n: int, entries: int) -> Heaps:
        entry = np.frombuffer(raw, np.uint8, n).copy()
        sizes = np.frombuffer(raw, "<i4", entries, n)
        keys = np.frombuffer(raw, "<f8", n, n + 4 * entries).tolist()
        parts = np.frombuffer(raw, "<i4", n, n + 4 * entries + 8 * n).tolist()
        heaps, at = [], 0
        for size in sizes.tolist():
            heaps.append(list(zip(keys[at : at + size], parts[at : at + size], strict=True)))
            at += size
        return cls(entry, heaps)

    @staticmethod
    def width(n: int, entries: int) -> int:
        return 13 * n + 4 * entries

    def popped(self, drift: np.ndarray, margin: float) -> list[int]:
        """The parts whose bounds the drift has violated, taken off their heaps."""
        out = []
        for heap, reached in zip(self.heaps, (drift + margin).tolist(), strict=True):
            while heap and heap[0][0] <= reached:
                out.append(heapq.heappop(heap)[1])
        return out

    def push(self, parts: list[int], entry: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> None:
        self.entry[parts] = entry
        for i, e, key in zip(parts, entry.tolist(), (slack + drift[entry]).tolist(), strict=True):
            heapq.heappush(self.heaps[e], (key, i))


def _margin(books: np.ndarray) -> float:
    """More than rounding can change a bound by."""
    return 1e-6 + 1e-11 * float(np.abs(books).max(initial=0))


def _step(books: np.ndarray, drift: np.ndarray):
    positions, entries, width = books.shape

    def run(vectors: np.ndarray, state: bytes, sums: list[int]) -> tuple[bytes, list[int]]:
        n, size = len(vectors), Heaps.width(len(vectors), entries)
        told, total, popped = [], np.array(sums[:-1], dtype=np.int64).reshape(positions, entries, width + 1), 0
        margin = max(_margin(books), 1e-11 * float(np.abs(vectors).max(initial=0)))
        for p in range(positions):
            own = vectors[:, p * width : (p + 1) * width]
            heaps = Heaps.load(state[p * size : (p + 1) * size], n, entries)
            parts = heaps.popped(drift[p], margin)
            popped += len(parts)
            if parts:
                best, slack = scan(own[parts], books[p])
                old = heaps.entry[parts]
                changed = np.flatnonzero(old != best)
                rows = np.concatenate([np.ones((len(changed), 1), dtype=np.int64), own[parts][changed]], axis=1)
                np.subtract.at(total[p], old[changed], rows)
                np.add.at(total[p], best[changed], rows)
                heaps.push(parts, best, slack, drift[p])
            told.append(heaps.dump())
        return b"".join(told), [*total.ravel().tolist(), popped]

    return run


def moved(books: np.ndarray, total: list[int]) -> np.ndarray:
    """Each entry at the floor of its parts' mean; unused entries stay."""
    sums = np.array(total, dtype=object).reshape(books.shape[0], books.shape[1], books.shape[2] + 1)
    out = books.copy()
    for p, e in np.ndindex(*books.shape[:2]):
        if sums[p, e, 0]:
            out[p, e] = [s // sums[p, e, 0] for s in sums[p, e, 1:]]
    return out


def drifted(drift: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The cumulative drift after a move: each entry's own, and the largest of another entry of its position."""
    away = (new - old).astype(float)
    steps = np.sqrt(np.einsum("pew,pew->pe", away, away))
    ordered = np.sort(steps, axis=1)
    largest = ordered[:, -1:]
    others = np.where(steps == largest, ordered[:, -2:-1] if steps.shape[1] > 1 else 0.0, largest)
    # of several entries that moved farthest, each has another one
    ties = (steps == largest).sum(axis=1, keepdims=True) > 1
    return drift + steps + np.where(ties, largest, others)


class Codes:
    """The outcome: ``coded`` (id, label, code, error) of every kept vector, the ``books`` (position, entry, component) and, for each
    pass, how many parts were popped and rescanned (``popped``)."""

    def __init__(self, df: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label"):
        """Vectors that are null or hold a null or a number that is not finite are left out. The size of the vectors is that of the
        smallest kept id's whose size the number of parts divides; others are left out too, as they have no parts to compare. The
        first entries are the parts of the smallest ids, equal ids in order of their components, null ids last; with fewer
        vectors there are fewer entries, and without any the result is empty. Repeated rows count as often as they are there,
        other columns are ignored, and integers beyond 2^26 count as 2^26. At most 256 entries."""
        rows = blocks.kept(df, id_col, vec_col, label_col).where((F.size("v") > 0) & (F.size("v") % parts == 0))
        order = [F.asc_nulls_last("id"), F.asc("v")]
        sized = rows.orderBy(*order).select(F.size("v")).first()
        self.popped: list[int] = []
        if sized is None:
            self.books, self.coded = np.zeros((parts, 0, 0), dtype=np.int64), df.sparkSession.createDataFrame([], RESULT)
            return
        dims = sized[0]
        rows = rows.where(F.size("v") == dims)
        first = blocks.integers(np.array([r[0] for r in rows.orderBy(*order).select("v").limit(entries).collect()]), scale)
        self.books = np.ascontiguousarray(first.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
        width, n = dims // parts, len(first)
        size = parts * n * (width + 1) + 1

        def begin(v: np.ndarray) -> tuple[bytes, list[int]]:
            total = np.zeros((parts, n, width + 1), dtype=np.int64)
            total[:, 0, 0], total[:, 0, 1:] = len(v), v.sum(axis=0).reshape(parts, width)
            return Heaps.fresh(len(v), n).dump() * parts, [*total.ravel().tolist(), 0]

        found, drift = blocks.blocks(rows, scale, dims, begin), np.zeros((parts, n))
        for last in [False] * rounds + [True]:
            before, found = found, blocks.advance(found, dims, _step(self.books, drift))
            total = blocks.totals(found, size)
            self.popped.append(total[-1])
            before.unpersist()
            if not last:
                old, self.books = self.books, moved(self.books, total[:-1])
                drift = drifted(drift, old, self.books)
        self.coded = materialise(found.mapInArrow(_rows(self.books), RESULT), "codes")
        found.unpersist()

    def digest(self) -> str:
        """SHA-256 of all entries' components as decimal integers, by position, entry and component."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _rows(books: np.ndarray):
    positions, entries, width = books.shape

    def run(chunks):
        for batch in chunks:
            for i in range(batch.num_rows):
                vectors = blocks.vectors_of(batch.column("vectors")[i].as_py(), positions * width)
                state, size = batch.column("state")[i].as_py(), Heaps.width(len(vectors), entries)
                entry = np.stack([np.frombuffer(state, np.uint8, len(vectors), p * size) for p in range(positions)], axis=1)
                away = vectors.reshape(len(vectors), positions, width) - books[np.arange(positions), entry]
                codes = [bytes(row).hex() for row in np.ascontiguousarray(entry)]
                yield pa.record_batch(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(codes, pa.string()), pa.array(np.einsum("npw,npw->n", away, away))],
                    names=["id", "label", "code", "error"],
                )

    return run


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """Adds the vector that a code stands for, as integers: the entries it names, one after the other."""
    entry = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    given = lambda p: F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in books[p]])
    return codes.withColumn("decoded", F.concat(*[F.get(given(p), entry(p)) for p in range(len(books))]))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Codes(table(spark, sf_dir, "embeddings"))
    key = F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label")))  # nulls are together
    keyed = done.coded.withColumn("_label", key)
    each = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return join_hot(keyed, each, "_label", by="id").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256"))
