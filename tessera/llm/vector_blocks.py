"""Vectors as integers, in blocks: what the operators on vectors share.

A block is one row with up to ``BLOCK`` vectors, the state that a task keeps about them, and their sums. Rounds go from block to
block without an exchange; only the sums, whose number does not depend on the number of vectors, are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block: some two megabytes at 64 components.
BLOCK = 4_096
#: Integers beyond this count as it, so that squared distances of up to 256 components fit 64 bits.
LARGEST = 1 << 26

BLOCKS = "ids array<bigint>, labels array<string>, vectors binary, state binary, sums array<bigint>"


def kept(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(id, label, v) of the rows whose vector is there and holds finite numbers only; labels as strings."""
    label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))  # no number is below NaN; a null vector is no yes


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


def blocks(rows: DataFrame, scale: int, dims: int, begin: Callable[[np.ndarray], tuple[bytes, list[int]]]) -> DataFrame:
    """The vectors of (id, label, v), all of ``dims`` components, as blocks; ``begin`` gives a block's first state and sums."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = integers(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                state, sums = begin(v)
                yield _batch([part.column("id").to_pylist()], [part.column("label").to_pylist()], [v.astype("<i4").tobytes()], [state], [sums])

    return rows.mapInArrow(run, BLOCKS)


def _batch(*columns: list) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["ids", "labels", "vectors", "state", "sums"])


def vectors_of(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)


def advance(found: DataFrame, dims: int, step: Callable[[np.ndarray, bytes], tuple[bytes, list[int]]]) -> DataFrame:
    """The blocks after a round: ``step`` takes a block's vectors, state and sums and gives the new state and sums.

    The blocks are kept in memory and on the executors' disks; a lost one is made again from the table, block by block."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = row.column("vectors")[0].as_py()
                state, sums = step(vectors_of(raw, dims), row.column("state")[0].as_py(), row.column("sums")[0].as_py())
                yield pa.record_batch([row.column("ids"), row.column("labels"), row.column("vectors"), pa.array([state], pa.binary()), pa.array([sums], pa.list_(pa.int64()))], names=row.schema.names)

    return found.mapInArrow(run, BLOCKS).persist(StorageLevel.MEMORY_AND_DISK)


def totals(found: DataFrame, size: int) -> list[int]:
    """The sums of all blocks, place by place: ``size`` numbers whatever the number of vectors."""
    each = found.select(F.posexplode("sums").alias("place", "n")).groupBy("place").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
    out = [0] * size
    for place, n in each.collect():
        out[place] = int(n)
    return out
