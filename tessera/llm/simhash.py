"""Near duplicates by SimHash, with an anchor-point covering for the search.

A 64-bit fingerprint is cut into three blocks of 21 or 22 bits. Two fingerprints that differ in at most four bits differ
in at most one bit of some block. The anchors of a block are the 4096 words of the binary Golay code of length 23, a
perfect covering code of radius 3: every block value lies within 3 bits of exactly one anchor. A fingerprint is
replicated to all anchors within 3 + 1 bits of its block value (about 5.3 for each block), so both members of a pair
meet at the anchor nearest to either of them, and they are compared there. No pair within the threshold is lost.

Scale: only distinct fingerprints travel (16 rows of 12 bytes each). A bucket of an anchor emits a spanning forest of
its links, not the pairs; buckets above ``BUCKET`` fingerprints are divided further, by an exact rule (:func:`links`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, hot_keys, join_hot, materialise, only, table

SHINGLE = 4
THRESHOLD = 4
#: Fingerprints of one anchor that one task compares; a larger bucket is divided.
BUCKET = 8192
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: First bit and width of the three blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """SimHash of one text: a bit is 1 where it is set in over half the shingle hashes; 0 without words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(starts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 400:
        votes = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64).reshape(8, 8)
    else:
        votes = np.stack([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits.reshape(-1)).view(np.uint64)[0])


def _fingerprints(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks:
        texts = batch.column(1)
        prints = np.fromiter((fingerprint(texts[i].as_py()) for i in range(batch.num_rows)), dtype=np.uint64, count=batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])


@lru_cache(1)
def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """Syndrome table: the error pattern of least weight for each of the 2048 syndromes, and the code words by weight."""
    shifts = np.array([GOLAY << i for i in range(12)], dtype=np.int64)
    words = np.zeros(4096, dtype=np.int64)
    for i, row in enumerate(shifts):
        words ^= np.where((np.arange(4096) >> i) & 1, row, 0)
    leaders = np.zeros(2048, dtype=np.int64)
    one = [1 << i for i in range(23)]
    errors = [0, *one]
    errors += [one[i] | one[j] for i in range(23) for j in range(i)]
    errors += [one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array(errors, dtype=np.int64)
    leaders[_syndrome(errors)] = errors
    return leaders, words


def _syndrome(values: np.ndarray) -> np.ndarray:
    """Remainder of the 23-bit polynomials modulo the generator."""
    left = values.copy()
    for bit in range(22, 10, -1):
        left ^= np.where((left >> bit) & 1, GOLAY << (bit - 11), 0)
    return left


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position, anchor) with the anchor within 4 bits of the value, for values of up to 23 bits.

    An anchor within 4 bits of a value v is the nearest anchor of v with up to one bit flipped, because the covering
    radius is 3; so decoding v and its 23 neighbours finds all of them.
    """
    leaders, _ = _golay()
    flips = np.array([0, *[1 << i for i in range(23)]], dtype=np.int64)
    near = values[:, None] ^ flips[None, :]
    found = near ^ leaders[_syndrome(near.reshape(-1))].reshape(near.shape)
    close = np.bitwise_count(found ^ values[:, None]) <= 4
    found = np.sort(np.where(close, found, -1), axis=1)
    keep = found >= 0
    keep[:, 1:] &= found[:, 1:] != found[:, :-1]
    rows, columns = np.nonzero(keep)
    return rows, found[rows, columns]


def _replicas(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(prints), 4096):
            part = prints[k : k + 4096]
            unsigned = part.view(np.uint64)
            for b, (first, width) in enumerate(BLOCKS):
                value = ((unsigned >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
                rows, code = anchors(value)
                yield pa.record_batch([pa.array(code + (b << 23), pa.int64()), pa.array(part[rows], pa.int64())], names=["anchor", "fp"])


class _Forest:
    """Union-find over the positions of an array; the root of a tree is its smallest position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = up
                return up
            up = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
            open_ = low != high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.up, high, low)


def forest(left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Root positions after linking all fingerprints within the threshold.

    ``right`` None: compare ``left`` with itself; else compare the two sides (positions count through both). The
    comparison is exact and done in tiles, so that memory stays bounded.
    """
    both = left if right is None else np.concatenate([left, right])
    trees, tile = _Forest(len(both)), 1024
    off = 0 if right is None else len(left)
    other = left if right is None else right
    for i in range(0, len(left), tile):
        for j in range(i if right is None else 0, len(other), tile):
            close = np.bitwise_count(left[i : i + tile, None] ^ other[None, j : j + tile]) <= THRESHOLD
            a, b = np.nonzero(close)
            a, b = a + i, b + j + off
            if right is None:
                a, b = a[a < b], b[a < b]
            trees.link(a, b)
    return trees.roots()


def _edges(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the buckets. In: (anchor, cell, side, fp) sorted by bucket; out: (a, b), a the root."""

    def links(fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if side[0] == 0 and side[-1] == 0:
            both = np.sort(fp.view(np.uint64))
            up = forest(both, None)
        else:
            cut = np.searchsorted(side, 2)
            left, right = np.sort(fp[:cut].view(np.uint64)), np.sort(fp[cut:].view(np.uint64))
            both = np.concatenate([left, right])
            up = forest(left, right) if cut and cut < len(fp) else np.arange(len(fp))
        high = np.nonzero(up != np.arange(len(up)))[0]
        return both[up[high]].view(np.int64), both[high].view(np.int64)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        if held:
            fp, side = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            if len(fp) > 1:
                a, b = links(fp, side)
                if len(a):
                    found.append((a, b))

    for batch in chunks:
        n = batch.num_rows
        if not n:
            continue
        anchor, cell, side, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cuts = np.nonzero((anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1]))[0] + 1
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            key = (anchor[a], cell[a])
            if key != last:
                close()
                last = key
            held.append((fp[a:b], side[a:b]))
        if found:
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            found.clear()
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
    close()
    if found:
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): a spanning forest for each anchor over the distinct fingerprints ``fp``; all links within 4 bits are kept.

    A bucket above ``BUCKET`` is divided by pieces: of five pieces of 12 or 13 bits, two fingerprints within 4 bits share
    one at least. A division that is still larger, which takes thousands of fingerprints close to each other, is dealt out
    as pairs of chunks.
    """
    spread = prints.select("fp").mapInArrow(_replicas, "anchor long, fp long")
    large = spread.groupBy("anchor").agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET)
    pieces = F.array(*[F.lit(p << 13) + F.shiftrightunsigned("fp", 13 * p).bitwiseAND(F.lit(8191)).cast("int") for p in range(5)])
    divided = spread.join(large, "anchor", "left").select("anchor", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(-1))).otherwise(pieces)).alias("piece"), "fp")
    sizes = divided.where("piece >= 0").groupBy("anchor", "piece").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    dealt = (
        divided.join(sizes, ["anchor", "piece"], "left")
        .withColumn("g", F.when(F.col("n").isNull(), 1).otherwise(F.ceil(F.col("n") / BUCKET).cast("int")))
        .withColumn("own", F.when(F.col("g") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select(
            "anchor",
            (F.col("piece").cast("long") * (1 << 40) + F.least("own", "with").cast("long") * (1 << 20) + F.greatest("own", "with")).alias("cell"),
            F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).alias("side"),
            "fp",
        )
    )
    return (
        dealt.repartition("anchor", "cell")
        .sortWithinPartitions("anchor", "cell", "side")
        .mapInArrow(_edges, "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by minimum labels with pointer jumping; root is the smallest node.

    Every round is an aggregation with partial sums and joins that deal the many neighbours of one node, or members of one
    root, to several tasks; rounds are written to the shared folder and deleted when read. The number of rounds grows with
    the logarithm of the longest chain.
    """
    pairs = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b"), "pairs")
    state = materialise(pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        # the smallest label next to each node, pushed to the node and to its root
        near = join_hot(pairs, state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b", by="a").select("a", "r")
        offered = (
            near.groupBy("a").agg(F.min("r").alias("r")).join(state.withColumnRenamed("node", "a"), "a")
        )
        offers = offered.select(F.col("a").alias("node"), F.least("r", "root").alias("root")).union(
            offered.select(F.col("root").alias("node"), F.least("r", "root").alias("root"))
        )
        lower = offers.groupBy("node").agg(F.min("root").alias("root"))
        # pointer jumping: follow the label of the label
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = join_hot(lower, jump, "root", by="node", how="left").select("node", F.coalesce("up", "root").alias("root"))
        new = materialise(after, "labels")
        moved = new.join(state.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        discard(state)
        state = new
        if not moved:
            discard(pairs)
            return state


def smallest_ids(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest id of each fingerprint's component, from nodes (fp, first, n) and labels (node, root).

    Only linked fingerprints are joined; the members of one root are dealt to several tasks."""
    linked = labels.withColumnRenamed("node", "fp").join(nodes.select("fp", "first"), "fp")
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    found = join_hot(linked.select("fp", "root"), firsts, "root", by="fp").select("fp", "component_id")
    return nodes.select("fp", "first").join(found, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def of_members(rows: DataFrame, members: DataFrame, hot: list) -> DataFrame:
    """``rows`` with their fingerprint's component; a fingerprint that many rows have (``hot``) is dealt by id to several tasks."""
    salts = 64
    own = F.when(F.col("fp").isin(hot), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0).cast("int") if hot else F.lit(0)
    each = F.explode(F.when(F.col("fp").isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    return rows.withColumn("_salt", own).join(members.withColumn("_salt", each), ["fp", "_salt"]).drop("_salt")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints link at 4 or fewer differing bits; a component's id is the smallest document id in it. Null and empty
    texts have fingerprint zero and are linked like any other. Repeated rows each give a row; a null id gives a row, and
    counts in no minimum unless the component has no other id. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    prints = materialise(rows.mapInArrow(_fingerprints, f"id {kind}, fp long"), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "nodes")
    edges = materialise(links(nodes), "edges")
    members = smallest_ids(nodes, components(edges))
    discard(edges)
    out = of_members(prints, members, hot_keys(nodes, "fp", "n"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's: one of each group of near copies stays.

    Of rows with the same id and text one stays. Documents without an id count as one group's only if all of it has none;
    they stay then, once for each text.
    """
    kept = near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "text"])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
