"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines with more than white space, trimmed). Each paragraph is hashed to a wide
vector and a text's fingerprint is the sum of its paragraphs' vectors:

- four lanes modulo 2^64, the 256-bit BLAKE2b digest of the paragraph: equal multisets have equal sums, others differ
  but for a chance of about 2^-256;
- 128 lanes modulo 2^16: each run of three words (fewer at the paragraph's end) adds +1 or -1 to one lane, both chosen
  by its hash. The squared length of a difference estimates how many runs two texts do not share.

Sums do not depend on the order of paragraphs, and paragraphs can be added and taken away later (:func:`plus`,
:func:`minus`). Likeness is 1 - |f - g|^2 / (|f|^2 + |g|^2) over the 128 lanes, between 0 and 1: 1 for equal multisets, about
0.5 if half of the runs are shared.

Scale: one exchange by ranges of the id brings each document beside the next one; the first document of a range is
copied to the range before it, so no window over the whole table is needed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import only, table

EXACT, LANES, RUN = 4, 128, 3
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

Print = tuple[np.ndarray, np.ndarray]


class Hasher:
    """Fingerprints of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def text(self, text: str) -> Print:
        known, digest = self.words, xxhash.xxh64_intdigest
        exact = np.zeros(EXACT, dtype=np.uint64)
        codes: list[int] = []
        for line in text.encode().split(b"\n"):
            line = line.strip()
            if line:
                exact += np.frombuffer(hashlib.blake2b(line, digest_size=8 * EXACT).digest(), dtype="<u8")
                for w in line.split():
                    h = known.get(w)
                    if h is None:
                        h = known[w] = digest(w) or 1
                    codes.append(h)
                codes += (0, 0)
        if len(known) > 1_000_000:
            known.clear()
        if not codes:
            return exact, np.zeros(LANES, dtype=np.uint16)
        h = np.array(codes, dtype=np.uint64)
        first, second, third = h[:-2], h[1:-1].copy(), h[2:].copy()
        third[second == 0] = 0  # a run ends with its paragraph
        x = (first * _A) ^ (second * _B + (second >> np.uint64(31))) ^ (third * _C + (third >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * _D
        x ^= x >> np.uint64(32)
        x = x[first != 0]
        sign = 1.0 - 2.0 * (x & np.uint64(1)).astype(np.float64)
        lanes = np.bincount((x >> np.uint64(57)).astype(np.int64), weights=sign, minlength=LANES)
        return exact, lanes.astype(np.int64).astype(np.uint16)


def plus(f: Print, g: Print) -> Print:
    """The fingerprint of both texts' paragraphs together."""
    return f[0] + g[0], f[1] + g[1]


def minus(f: Print, g: Print) -> Print:
    """The fingerprint after g's paragraphs are deleted from f's."""
    return f[0] - g[0], f[1] - g[1]


def as_hex(f: Print) -> str:
    return (f[0].astype("<u8").tobytes() + f[1].astype("<u2").tobytes()).hex()


def from_hex(text: str) -> Print:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: 8 * EXACT], dtype="<u8").astype(np.uint64), np.frombuffer(raw[8 * EXACT :], dtype="<u2").astype(np.uint16)


def _square(lanes: np.ndarray) -> float:
    signed = lanes.view(np.int16).astype(np.float64)
    return float(signed @ signed)


def likeness(f: Print, g: Print) -> float:
    """0 to 1, from the fingerprints alone; two texts without paragraphs are equal."""
    if (f[0] == g[0]).all():
        return 1.0
    both = _square(f[1]) + _square(g[1])
    return min(1.0, max(0.0, 1.0 - _square(f[1] - g[1]) / both)) if both else 0.0


def _compare(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: (part, copy, id, text), sorted; out: each document that is no copy, with what came after it in its part."""
    hasher = Hasher()
    held = None  # (part, id, text, print)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types: list[pa.DataType] = []
    rows: list[tuple] = []

    def pair(now: tuple, text: str, fp: Print) -> tuple:
        _, key, own, own_fp = now
        n = len(own)
        edited = own[: n - n // 2] + text[: n // 2]
        edited_fp = hasher.text(edited)
        return (key, n, hashlib.sha256(edited.encode()).hexdigest(), as_hex(own_fp), as_hex(edited_fp), likeness(own_fp, edited_fp), likeness(own_fp, fp))

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows.clear()
        return batch

    for batch in chunks:
        types = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        part, copy, key, text = (batch.column(k) for k in range(4))
        for i in range(batch.num_rows):
            p, is_copy = part[i].as_py(), copy[i].as_py()
            if is_copy and (held is None or held[0] != p):
                continue  # a further copy: the part's last document has met the first
            now = text[i].as_py()
            fp = hasher.text(now)
            if held is not None and held[0] == p:
                rows.append(pair(held, now, fp))
            held = None if is_copy else (p, key[i].as_py(), now, fp)
            if len(rows) >= 500:
                yield out()
    if rows:
        yield out()


def _count_up_to(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are <= value, in about 2 * sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    coarse, pieces = bounds[width - 1 :: width], [bounds[i : i + width - 1] for i in range(0, len(bounds), width)]
    pieces += [[]] * (len(coarse) + 1 - len(pieces))
    kind = "array<bigint>"
    block = F.size(F.filter(F.lit(coarse).cast(kind), lambda b: b <= value)) if coarse else F.lit(0)
    fine = F.array(*[F.lit(p).cast(kind) if p else F.array().cast(kind) for p in pieces])
    return F.coalesce(block * width + F.size(F.filter(F.element_at(fine, block + 1), lambda b: b <= value)), F.lit(0))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to the edited text's and the next document's.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document, in
    ascending order of id; the first document comes after the last. Returns (doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next), a row for each row. A null text counts as empty; null ids
    come first; rows of one id follow each other by a hash of their text; a lone document is its own next one. An empty
    table gives an empty result; other columns are ignored. Ids are integers.
    """
    spark = docs.sparkSession
    rows = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    low, nulls, bounds = rows.agg(
        F.min("id"), F.count_if(F.col("id").isNull()), F.percentile_approx("id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))
    ).first()
    bounds = sorted({b for b in bounds or [] if b != low})
    starts = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    part = _count_up_to(bounds, F.col("id"))
    first = F.col("id").isNull() if nulls else F.col("id") == F.lit(low)
    placed = rows.withColumn("own", part).withColumn(
        "part",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("own").alias("part"), F.lit(False).alias("copy")),
                    F.when((F.col("own") > 0) & (F.try_element_at(starts, F.greatest("own", F.lit(1))) == F.col("id")), F.struct((F.col("own") - 1).alias("part"), F.lit(True).alias("copy"))),
                    F.when(first, F.struct(F.lit(len(bounds)).alias("part"), F.lit(True).alias("copy"))),
                )
            )
        ),
    )
    placed = placed.select("part.part", "part.copy", "id", "text")
    near = placed.repartition("part").sortWithinPartitions("part", "copy", "id", F.xxhash64("text"), "text")
    out = near.mapInArrow(
        _compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("id", id_col)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
