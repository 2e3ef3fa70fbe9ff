"""Exact dense search over cells of vectors: what cannot be among the best is not compared.

Every vector lies in the cell of its nearest centre. A block holds vectors of one cell with that centre and the largest distance from it, the
radius. A query's dot product with any of them is at most its product with the centre plus its length times the radius. The best cells of a
query are compared first; its k-th score is then its threshold, and blocks whose bound is below it are not unpacked for that query.
Results are exact, whatever the cells: these only decide how much is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import retrieval
from tessera.operators.scratch import written

#: Cells at most (their centres travel to the tasks), vectors in a block, and cells that a query's threshold is taken from.
CELLS, BLOCK, SEEDS = 4_096, 1_024, 4
#: More than the rounding of a product can make of a bound, as a share of the lengths.
SLACK = 1e-9

BLOCKS = "cell int, radius double, centre array<double>, chunk_ids array<bigint>, vectors array<float>"


def centres_of(index: DataFrame, n_cells: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, at most CELLS of them."""
    rows = index.orderBy(F.xxhash64("chunk_id"), "chunk_id").select(F.col("vec").cast("array<double>")).limit(n_cells).collect()
    return np.unique(np.array([r[0] for r in rows], dtype=np.float64), axis=0)


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (v * v).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(axis=1)[None, :]
    return (cell := d.argmin(axis=1)).astype(np.int32), np.sqrt(np.maximum(((v - centres[cell]) ** 2).sum(axis=1), 0))


def build(chunks: DataFrame, n_cells: int = 0) -> DataFrame:
    """Blocks of the vectors of (chunk_id, vec); null vectors are left out. ``n_cells`` is the root of their number if not given.

    Rows are dealt by ranges of cell and id, so that a cell with a large share of all vectors is divided too."""
    index = chunks.where("vec IS NOT NULL").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("vec").cast("array<float>").alias("vec"))
    n_cells = n_cells or int(index.count() ** 0.5) + 1
    centres = centres_of(index, min(n_cells, CELLS))
    if not len(centres):
        return chunks.sparkSession.createDataFrame([], BLOCKS)
    sent = chunks.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, away = _nearest(_matrix(b.column("vec"), sent.value.shape[1]), sent.value)
                yield pa.record_batch([b.column("chunk_id"), b.column("vec"), pa.array(cell), pa.array(away)], names=["chunk_id", "vec", "cell", "away"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away = b.column("cell").to_numpy(), b.column("away").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                for at in range(start, end, BLOCK):
                    stop = min(at + BLOCK, end)
                    columns = [[int(cell[at])], [float(away[at:stop].max())], [sent.value[cell[at]].tolist()]]
                    ids, flat = b.column("chunk_id").slice(at, stop - at), b.column("vec").slice(at, stop - at).flatten()
                    lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (ids, flat)]
                    yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2], pa.list_(pa.float64())), *lists], names=["cell", "radius", "centre", "chunk_ids", "vectors"])

    assigned = index.mapInArrow(assign, "chunk_id bigint, vec array<float>, cell int, away double")
    dealt = assigned.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", F.desc("away"))  # like distances share a block
    return written(dealt.mapInArrow(pack, BLOCKS), "cells")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dims:
        raise ValueError(f"the index has vectors of {len(flat) / len(column):g} dimensions, the queries of {dims}: reindex")
    return flat.reshape(len(column), dims)


def _compare(sent, k: int):
    """The best k of a task for each query from the blocks that it asks for. ``sent`` is a broadcast of ids, queries, their lengths,
    thresholds, and the seeds: the queries of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, sizes, least, seeds, first = sent.value
        best, names = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), dtype=np.int64)
        n_all = n_read = 0
        most = 0.0
        for b in batches:
            for i in range(b.num_rows):
                cell, n = b.column("cell")[i].as_py(), len(b.column("chunk_ids")[i].values)
                own = seeds.get(cell, np.zeros(0, dtype=np.int64))
                if not first:
                    centre = np.array(b.column("centre")[i].as_py())
                    if len(centre) != queries.shape[1]:
                        raise ValueError(f"the index has vectors of {len(centre)} dimensions, the queries of {queries.shape[1]}: reindex")
                    bound = queries @ centre + sizes * b.column("radius")[i].as_py()
                    wanted = np.flatnonzero(bound + SLACK * sizes * (1 + np.linalg.norm(centre)) >= least)
                    own = np.setdiff1d(wanted, own, assume_unique=True)
                    n_all += len(queries)
                n_read += len(own)
                if not len(own):
                    continue
                keys = b.column("chunk_ids")[i].values.to_numpy()
                vectors = b.column("vectors")[i].values.to_numpy().astype(np.float64).reshape(n, -1)
                longest = float(np.sqrt((vectors * vectors).sum(axis=1)).max(initial=0))
                most = max(most, longest)
                for at in range(0, len(own), retrieval.TILE):
                    here = own[at : at + retrieval.TILE]
                    scores = queries[here] @ vectors.T
                    # queries with no score that reaches their task's k-th, or the threshold, keep what they have
                    reach = scores.max(axis=1)
                    some = (reach >= best[here, -1]) & (reach >= least[here] - SLACK * sizes[here] * (1 + longest))
                    if some.any():
                        best[here[some]], names[here[some]] = retrieval._first(best[here[some]], names[here[some]], scores[some], keys, k)
        q, place = np.nonzero((best > -np.inf) & (best >= (least - SLACK * sizes * (1 + most))[:, None]))
        if len(q):
            yield pa.record_batch([ids.take(pa.array(q)), pa.array(names[q, place]), pa.array(best[q, place]), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.int64())], names=["query_id", "chunk_id", "score", "n_blocks", "n_read"])
        if len(ids) and (n_all or n_read):
            yield pa.record_batch([ids.slice(0, 1), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([n_all]), pa.array([n_read])], names=["query_id", "chunk_id", "score", "n_blocks", "n_read"])

    return run


class CellSearch:
    """Dense search over blocks. ``found`` has (query_id, chunk_id, score, rank), the same as :func:`retrieval.dense_search`.

    Queries (query_id of any type with an order, vec) are collected when the search is made, ``retrieval.QUERIES`` at a time, and compared with their best cells for their
    thresholds; a larger set takes a pass over the blocks for each of these parts. ``share`` says how many comparisons of a query with a block there could be and how many were made."""

    def __init__(self, blocks: DataFrame, queries: DataFrame, k: int = retrieval.DENSE_K):
        kind = queries.schema["query_id"].dataType
        schema = f"query_id {kind.simpleString()}, chunk_id bigint, score double, n_blocks bigint, n_read bigint"
        known, rows = None, None
        for ids, matrix in retrieval.query_blocks(queries):
            if known is None:
                known = blocks.groupBy("cell").agg(F.max("radius").alias("radius"), F.first("centre").alias("centre")).collect()  # at most CELLS
            part = self._searched(blocks, known, ids, matrix, k, schema)
            rows = part if rows is None else rows.unionByName(part)
        self.rows = blocks.sparkSession.createDataFrame([], schema) if rows is None else rows
        self.found = retrieval.top(self.rows.where("chunk_id IS NOT NULL").select("query_id", "chunk_id", "score"), k, ["query_id"], F.desc("score"), F.asc("chunk_id"))

    @staticmethod
    def _searched(blocks: DataFrame, known: list, ids: pa.Array, matrix: np.ndarray, k: int, schema: str) -> DataFrame:
        sizes = np.linalg.norm(matrix, axis=1)
        seeds: dict[int, list[int]] = {}
        if known and len(known[0]["centre"]) == matrix.shape[1]:
            centres, radii = np.array([c["centre"] for c in known]).T, np.array([c["radius"] for c in known])[None, :]
            for at in range(0, len(matrix), retrieval.TILE):
                here = slice(at, at + retrieval.TILE)
                for q, near in enumerate(np.argsort(-(matrix[here] @ centres + sizes[here, None] * radii), axis=1, kind="stable")[:, :SEEDS], at):
                    for c in near:
                        seeds.setdefault(known[c]["cell"], []).append(q)
        own = {c: np.array(q, dtype=np.int64) for c, q in seeds.items()}
        send = lambda least, first: blocks.sparkSession.sparkContext.broadcast((ids, matrix, sizes, least, own, first))
        least = np.full(len(matrix), -np.inf)
        start = written(blocks.where(F.col("cell").isin(list(own))).mapInArrow(_compare(send(least, True), k), schema), "near")
        kth = retrieval.top(start.where("chunk_id IS NOT NULL"), k, ["query_id"], F.desc("score"), F.asc("chunk_id")).where(F.col("rank") == k)
        at = {_key(i): n for n, i in enumerate(ids.to_pylist())}
        least = least.copy()
        for r in kth.select("query_id", "score").collect():  # one row for each query
            least[at[_key(r[0].asDict() if isinstance(r[0], retrieval.Row) else r[0])]] = r[1]
        return start.unionByName(blocks.mapInArrow(_compare(send(least, False), k), schema))

    def share(self) -> DataFrame:
        """One row: n_blocks, n_read."""
        return self.rows.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n_blocks"), F.coalesce(F.sum("n_read"), F.lit(0)).alias("n_read"))


def _key(value) -> object:
    return tuple(value.values()) if isinstance(value, dict) else value
