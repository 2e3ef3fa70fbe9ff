"""Near copies by the Jaccard similarity of their word shingles: candidates by SimHash and MinHash, every link checked exactly.

Texts whose SimHashes link through the anchors of :mod:`simhash` are candidates. At a similarity of 0.8, though, two SimHashes
differ in about ten bits of 64, too many for a covering of bit blocks. So further candidates come from bands: the least hashes of a text's shingles under ``BANDS`` x ``ROWS`` functions make ``BANDS`` keys; texts of similarity s share
one with probability 1 - (1 - s^5)^24: all but 7 in 100,000 pairs at 0.8 and fewer above. Texts that share keys, also
through others, are a loose group; within it all pairs are compared by their whole shingle sets.

Scale: a distinct text travels as 24 keys, and once more as text. A key emits a star, not its pairs. Loose groups above
``CHUNK`` texts are dealt out as pairs of chunks, so that a group of n texts is sent n / ``CHUNK`` times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, hot_keys, join_hot, materialise, only
from tessera.llm.simhash import _fingerprints, components, of_members, smallest_ids
from tessera.llm.simhash import links as simhash_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts of one loose group that one task compares with each other; a larger group is dealt out.
CHUNK = 512

_RANDOM = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words; of all words where there are fewer, so that empty texts are alike."""
    words = (text or "").encode().lower().split()
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n < size:
        return np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = np.concatenate(([0], ends[: n - size])).tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(starts)))


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band: the hash of the least values of its functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 2048):
        mixed = (hashes[None, k : k + 2048] ^ _XOR) * _TIMES
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    octets, width = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(octets[b * width : (b + 1) * width], b) for b in range(BANDS)]


def _keys(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks:
        found = np.array([bands(shingles(t.as_py())) for t in batch.column(1)], dtype=np.uint64).reshape(-1)
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(found.view(np.int64))], names=["fp", "key"])


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of shingle sets whose Jaccard similarity is ``least`` or more; ``right`` None: within ``left``."""
    both = left if right is None else left + right
    lengths = np.array([len(s) for s in both], dtype=np.int64)
    owners = np.repeat(np.arange(len(both)), lengths)
    _, columns, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[columns]
    owners, columns = owners[keep], place[columns[keep]]
    order = np.argsort(columns, kind="stable")
    owners, columns = owners[order], columns[order]
    cut = len(left)
    common = np.zeros((cut, cut if right is None else len(right)), dtype=np.float32)
    total, tile = int(shared.sum()), 4096
    for first in range(0, total, tile):
        a, b = np.searchsorted(columns, [first, first + tile])
        held = np.zeros((len(both), min(tile, total - first)), dtype=np.float32)
        held[owners[a:b], columns[a:b] - first] = 1
        common += held[:cut] @ (held if right is None else held[cut:]).T
    other = lengths if right is None else lengths[cut:]
    a, b = np.nonzero(common >= least * (lengths[:cut, None] + other[None, :] - common) - 1e-9)
    return (a[a < b], b[a < b]) if right is None else (a, b + cut)


def _edges(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells. In: (root, low, high, side, fp, text) sorted by cell; out: (a, b), a spanning forest of each cell."""
    last, nodes, sets, sides = None, [], [], []

    def close() -> pa.RecordBatch | None:
        if len(nodes) < 2:
            return None
        cut = len(nodes) if sides[-1] == 0 else int(np.searchsorted(sides, 2))
        if not cut or (sides[-1] != 0 and cut == len(nodes)):
            return None
        a, b = similar(sets[:cut], None if sides[-1] == 0 else sets[cut:])
        up, kept = list(range(len(nodes))), []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                up[max(p, q)] = min(p, q)
                kept.append((nodes[x], nodes[y]))
        return pa.record_batch([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

    for batch in chunks:
        rows = batch.to_pydict()
        for cell in zip(rows["root"], rows["low"], rows["high"], rows["side"], rows["fp"], rows["text"], strict=True):
            if cell[:3] != last:
                if out := close():
                    yield out
                last, nodes, sets, sides = cell[:3], [], [], []
            nodes.append(cell[4])
            sets.append(shingles(cell[5]))
            sides.append(cell[3])
    if out := close():
        yield out


def links(rows: DataFrame) -> DataFrame:
    """(a, b): links between the texts ``fp`` of (fp, text) that join all whose similarity is SIMILARITY or more."""
    prints = materialise(rows.select("fp", "text").mapInArrow(_fingerprints, "id long, fp long").distinct(), "prints")
    near = components(simhash_links(prints.select("fp").distinct()))
    anchored = join_hot(prints, near.withColumnRenamed("node", "fp"), "fp", by="id", how="left")
    alike = materialise(anchored.select(F.col("id").alias("fp"), F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key")), "alike")
    discard(prints)
    banded = materialise(rows.select("fp", "text").mapInArrow(_keys, "fp long, key long"), "keys")
    keys = banded.unionByName(alike)  # each written by itself: a task that sorts for a join does not run Python as well
    centres = keys.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("_max")).where("a <> _max").select("key", "a")
    stars = materialise(keys.join(centres, "key").select("a", F.col("fp").alias("b")).where("a <> b").distinct(), "stars")
    loose = components(stars)
    discard(banded)
    discard(alike)
    discard(stars)
    sizes = loose.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("g"))
    members = join_hot(loose, sizes, "root", by="node").select(F.col("node").alias("fp"), "root", "g")
    dealt = (
        rows.select("fp", "text").dropDuplicates(["fp"]).join(members, "fp")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select(
            "root", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"),
            F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).alias("side"), "fp", "text",
        )
    )
    return dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "side").mapInArrow(_edges, "a long, b long").distinct()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row.

    Texts link at a similarity of ``SIMILARITY`` or more between their sets of ``SHINGLE``-word shingles; a component's id is
    the smallest document id in it. Null and empty texts are linked. Repeated rows each give a row; a null id gives a row,
    and counts in no minimum unless the component has no other id.
    """
    rows = only(docs, id=id_col, text=text_col).withColumn("fp", F.xxhash64(F.coalesce("text", F.lit(""))))
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes")
    edges = materialise(links(rows), "edges")
    members = smallest_ids(nodes, components(edges))
    discard(edges)
    return of_members(rows.select("id", "fp"), members, hot_keys(nodes, "fp", "n")).select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's; of rows with the same id and text one stays. Documents without an id
    stay, once for each text, if all of their component has none."""
    kept = near_copies(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "text"])
