"""Block-max postings: an inverted index whose blocks carry the most that they can add to a score.

A block holds the postings of one token in neighbouring chunks of like length; all postings of a chunk lie in blocks of the same
number. A block's largest weight and smallest length bound what it adds to a score, so the bounds of a question's tokens, summed by block
number, bound every score in these blocks. The best blocks of a question are scored first; the score of their k-th chunk is its threshold,
and blocks whose bound is below it are neither unpacked nor scored. Nothing is lost: scores are exact, and so are ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval
from tessera.operators.postings import PLAIN, phrase_entries, terms_of, weight
from tessera.operators.postings import rows as rows_of
from tessera.operators.scratch import written

#: Chunk ids that may share a block; within them, chunks of like length do.
SPAN = 1_024
#: Lengths of a block are within a factor of two to the power of 1 / CLASSES of each other.
CLASSES = 2
#: Blocks that a task packs at once.
HELD = 20_000
#: Blocks of a question that are scored for its threshold.
SEEDS = 12
#: Tokens up to which they are a filter of the reader.
PUSHED = 200
#: More than the rounding of sums can make of a bound.
SLACK = 1e-6

BLOCKS = "token string, block bigint, n int, most int, least int, chunk_ids array<bigint>, ds array<int>, fs array<int>, places array<array<int>>"
COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]


def block_of(chunk_id: Column, d: Column) -> Column:
    """The number of a chunk's blocks: ids that follow each other share it where their lengths are alike."""
    kind = F.least(F.lit(63), F.floor(CLASSES * F.log2(d.cast("double") + 1)))
    return (F.floor(chunk_id / F.lit(SPAN)) * 64 + kind).cast("bigint")


def built(chunks: DataFrame, tokens=T.index_tokens) -> DataFrame:
    """Blocks of chunks: the texts are dealt by span of their ids, and all that follows stays in their task, so far less is exchanged than
    the postings are; a group is never larger than SPAN."""
    dealt = chunks.select("chunk_id", "text", "heading", F.floor(F.col("chunk_id") / F.lit(SPAN)).alias("span")).repartition("span")
    if tokens not in PLAIN:
        each = rows_of(dealt, "span", tokens=tokens).select("span", "chunk_id", "d", F.inline_outer("entries")).where("token IS NOT NULL")
        return _packed(each.groupBy("span", "token", block_of(F.col("chunk_id"), F.col("d")).alias("block")))
    ends = chunks.sparkSession.range(31).select(F.expr("shiftleft(1L, cast(id as int)) AS n"))  # where a class begins, it is as block_of has it
    kinds = {r[0]: r[1] for r in ends.select(F.col("n") - 1, block_of(F.lit(0), F.col("n") - 1)).collect()}
    return dealt.sortWithinPartitions("span", "chunk_id").mapInArrow(_blocks_of(PLAIN[tokens], kinds), BLOCKS)


def _blocks_of(tokens, kinds: dict[int, int]):
    """Blocks of chunks that come in order of their spans; a task holds one span's postings."""

    def packed(span: int, held: dict) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for at in range(0, len(keys), HELD):
            some = keys[at : at + HELD]
            lists = [held[x] for x in some]
            ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            cuts = ends([len(x) for x in lists])
            flat = [p for x in lists for p in x]
            ids, ds, fs = pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int32()), pa.array([p[2] for p in flat], pa.int32())
            places = pa.ListArray.from_arrays(ends([len(p[3]) for p in flat]), pa.array([i for p in flat for i in p[3]], pa.int32()))
            head = [
                pa.array([t for _, t in some], pa.string()), pa.array([span * 64 + kind for kind, _ in some], pa.int64()), pa.array([len(x) for x in lists], pa.int32()),
                pa.array([max(p[2] for p in x) for x in lists], pa.int32()), pa.array([min(p[1] for p in x) for x in lists], pa.int32()),
            ]
            yield pa.record_batch([*head, *[pa.ListArray.from_arrays(cuts, x) for x in (ids, ds, fs, places)]], names=COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list] = {}
        last = None
        for b in batches:
            for chunk, text, heading, span in zip(*b.columns, strict=True):
                if (span := span.as_py()) != last:
                    yield from packed(last, held)
                    held, last = {}, span
                said, above = tokens(text.as_py()), tokens(heading.as_py())
                d, chunk = len(said) + len(above), chunk.as_py()
                found: dict[str, list[int]] = {}
                for i, t in enumerate(said):
                    found.setdefault(t, []).append(2 * i)
                for i, t in enumerate(above):
                    found.setdefault(t, []).append(2 * i + 1)
                titled = set(above)
                kind = kinds[d] if d in kinds else min(63, int(CLASSES * math.log2(d + 1)))
                for t, places in found.items():
                    more = sum(p % 2 for p in places) if t in titled else 0
                    held.setdefault((kind, t), []).append((chunk, d, len(places) + more, sorted(places) if more else places))
        yield from packed(last, held)

    return run


def _packed(groups: GroupedData) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("chunk_id", "d", weight(F.col("places")).alias("f"), "places")))
    return groups.agg(listed.alias("r")).select(
        "token", "block", F.size("r").alias("n"), F.array_max("r.f").alias("most"), F.array_min("r.d").alias("least"),
        F.col("r.chunk_id").alias("chunk_ids"), F.col("r.d").alias("ds"), F.col("r.f").alias("fs"), F.col("r.places").alias("places"),
    )


def blocked(rows: DataFrame) -> DataFrame:
    """Blocks from (token, chunk_id, d, places): one exchange by token and block, so that no group is larger than SPAN."""
    return _packed(rows.groupBy("token", block_of(F.col("chunk_id"), F.col("d")).alias("block")))


def unblocked(blocks: DataFrame) -> DataFrame:
    """(token, chunk_id, d, places): what :func:`blocked` took."""
    return blocks.select("token", F.inline(F.arrays_zip("chunk_ids", "ds", "places"))).select("token", F.col("chunk_ids").alias("chunk_id"), F.col("ds").alias("d"), "places")


@dataclass
class Store:
    """Blocks with the figures of their corpus; ``dead`` are chunk ids whose postings no longer count."""

    blocks: DataFrame
    n_chunks: float
    avg_tokens: float
    dead: DataFrame | None = None
    tokens: object = T.index_tokens

    @classmethod
    def build(cls, chunks: DataFrame, *, tokens=T.index_tokens) -> Store:
        kept = written(built(chunks, tokens), "blocks")
        total = kept.agg(F.sum(F.aggregate("places", F.lit(0).cast("bigint"), lambda s, p: s + F.size(p)))).first()[0] or 0
        n = chunks.count()
        return cls(kept, float(n), total / max(n, 1), None, tokens)

    def of(self, words: list[str]) -> DataFrame:
        """The live blocks of these tokens; where chunks are dead, the tokens' blocks are made anew without them."""
        wanted = self.blocks.sparkSession.createDataFrame([(w,) for w in words], "token string")
        least, most = F.lit(min(words, default="")), F.lit(max(words, default=""))  # files and row groups are in order of tokens
        # few words reach the reader as a filter; many, as a join of a size that the caller has checked
        found = self.blocks.where(F.col("token").isin(words)) if len(words) <= PUSHED else self.blocks.where(F.col("token").between(least, most)).join(F.broadcast(wanted), "token", "left_semi")
        return found if self.dead is None else blocked(unblocked(found).join(self.dead, "chunk_id", "left_anti"))


def _block_scores(sent, k: int, mean: float):
    """Scores of one block number's chunks for the questions that ask for it; ``sent`` is a broadcast of (question, weight) by token."""

    def run(found: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, none = pairs.column("query_id").combine_chunks(), pa.array([], pa.int64())
        if not pairs.num_rows or not found.num_rows:
            return pa.table([ids.slice(0, 0), none, pa.array([], pa.float64())], names=["query_id", "chunk_id", "score"])
        place = {retrieval._key(q): i for i, q in enumerate(ids.to_pylist())}
        chunk_ids, ds, fs = (found.column(c).combine_chunks() for c in ("chunk_ids", "ds", "fs"))
        lengths, flat = chunk_ids.value_lengths().to_numpy(), chunk_ids.flatten().to_numpy()
        names, at = np.unique(flat, return_inverse=True)
        f, d = fs.flatten().to_numpy().astype(np.float64), ds.flatten().to_numpy()
        part = f * (retrieval.K1 + 1) / (f + retrieval.K1 * (1 - retrieval.B + retrieval.B * d / mean))
        scores, seen, end = np.zeros((len(ids), len(names))), np.zeros((len(ids), len(names)), dtype=bool), 0
        for token, n in zip(found.column("token").to_pylist(), lengths, strict=True):
            here, end = slice(end, end + n), end + n
            for query, idf in sent.value.get(token, ()):
                if query in place:  # a chunk has a token once
                    scores[place[query], at[here]] += idf * part[here]
                    seen[place[query], at[here]] = True
        scores = np.round(scores, 9)
        least = np.array([-np.inf if x is None else x for x in pairs.column("least").to_pylist()])[:, None]
        best, chosen = retrieval._first(np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64), np.where(seen & (scores >= least), scores, -np.inf), names, k)
        q, i = np.nonzero(best > -np.inf)
        return pa.table([ids.take(pa.array(q)), pa.array(chosen[q, i]), pa.array(best[q, i])], names=["query_id", "chunk_id", "score"])

    return run


class BlockSearch:
    """BM25 over blocks. ``found`` has (query_id, chunk_id, score, rank), the same as :func:`retrieval.bm25_search`; ``share`` says
    for each question how many blocks there are and how many were scored.

    The bounds and the seeds are found when the search is made; ``found`` is computed when it is read."""

    def __init__(self, store: Store, queries: DataFrame, k: int = retrieval.BM25_K):
        self.store, self.k = store, k
        terms = terms_of(queries, store.tokens)
        words = [r[0] for r in terms.select(F.explode("parts").alias("w")).distinct().limit(retrieval.TERMS + 1).collect()]
        if len(words) > retrieval.TERMS:
            raise ValueError(f"more than {retrieval.TERMS} distinct tokens: search in several batches")
        live = store.of(words)
        self.blocks = live if store.dead is None else written(live, "live")
        long = terms.where(F.size("parts") > 1)
        if not long.isEmpty():
            split = [r[0] for r in long.select(F.explode("parts")).distinct().collect()]  # some of the words above
            whole = phrase_entries(unblocked(self.blocks.where(F.col("token").isin(split))), long.select("term", "parts").distinct())
            self.blocks = self.blocks.unionByName(written(blocked(whole), "phrases").select(*COLUMNS))
        weights = terms.groupBy("query_id", "token").agg(F.count("*").alias("times"))
        n, meta = store.n_chunks, self.blocks.select("token", "block", "n", "most", "least")
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = meta.groupBy("token").agg(F.sum("n").alias("df")).select("token", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
        self.asked = F.broadcast(written(weights.join(known, "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("idf")), "asked"))  # the queries' terms
        most = F.col("idf") * self._part(F.col("most"), F.col("least"))
        self.bounds = written(meta.join(self.asked, "token").groupBy("query_id", "block").agg(F.sum(most).alias("bound"), F.count("*").alias("n_blocks")), "bounds")
        ranked = retrieval.top(self.bounds, SEEDS, ["query_id"], F.desc("bound"), F.asc("block"), name="_seed")
        self.seeds = ranked.select("query_id", "block", "bound", "n_blocks")
        first = written(retrieval.top(self._scored(self.seeds.withColumn("least", F.lit(None).cast("double"))), k, ["query_id"], F.desc("score"), F.asc("chunk_id")), "seeds")
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))  # none where fewer than k are found
        rest = self.bounds.join(self.seeds.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left")
        rest = rest.where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
        self.rest = rest.select("query_id", "block", "bound", "n_blocks")
        both = first.select("query_id", "chunk_id", "score").unionByName(self._scored(rest).select("query_id", "chunk_id", "score"))
        self.found = retrieval.top(both, k, ["query_id"], F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "score", "rank")

    def _part(self, f: Column, d: Column) -> Column:
        k1, b = retrieval.K1, retrieval.B
        return f * (k1 + 1) / (f + k1 * (1 - b + b * d / F.lit(self.store.avg_tokens)))

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of the first k chunks in each of the blocks (query_id, block, least), none below ``least``: all of a chunk's
        postings lie in blocks of one number. Postings are exchanged once by that number, whatever number of questions ask for them."""
        kind = pairs.schema["query_id"].dataType.simpleString()
        asked = self.asked.select("token", "query_id", "idf").groupBy("token").agg(F.collect_list(F.struct("query_id", "idf")).alias("a"))
        sent = self.blocks.sparkSession.sparkContext.broadcast({r[0]: [(retrieval._key(q), w) for q, w in r[1]] for r in asked.collect()})  # the queries' terms
        wanted = self.blocks.select("token", "block", "chunk_ids", "ds", "fs")
        both = wanted.groupBy("block").cogroup(pairs.select("query_id", "block", "least").groupBy("block"))
        return both.applyInArrow(_block_scores(sent, self.k, self.store.avg_tokens), f"query_id {kind}, chunk_id bigint, score double")

    def share(self) -> DataFrame:
        """(query_id, n_blocks, n_scored)."""
        total = lambda df, name: df.groupBy("query_id").agg(F.sum("n_blocks").alias(name))
        scored = total(self.seeds.unionByName(self.rest), "n_scored")
        return total(self.bounds, "n_blocks").join(scored, "query_id")
