"""The stored index as immutable segments: what a change writes follows what it changes.

A commit writes one segment: the rows of new and changed documents, their chunks and blocks of postings, and what these replace in
older segments (rows of documents, ids of chunks). A manifest names the live segments with the figures of the corpus; it moves when the
segment is complete, so that a crash before that changes nothing. Segments whose sizes have come close are merged, newest first, and the dead
go then; there are as many as the logarithm of the corpus. Folders that no kept manifest names are deleted.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.porter import stemmed_tokens
from tessera.operators import blocks
from tessera.operators.pointer import Pointer
from tessera.operators.scratch import written

DOCUMENTS = "doc_id bigint, path string, title string, ext string, bytes bigint, mtime double, sha256 string, n_chunks int"
CHUNKS = "chunk_id bigint, doc_id bigint, ord int, heading string, page int, text string, vec array<float>"
STORED = {
    "documents": f"{DOCUMENTS}, seq int",
    "chunks": f"{CHUNKS}, d int, embedded string",
    "blocks": blocks.BLOCKS,
    "dropped": "doc_id bigint, seq int",
    "killed": "chunk_id bigint",
}
EMPTY = {"generation": 0, "roots": [], "embed_model": None, "schema_version": 2, "n_chunks": 0, "n_tokens": 0, "next_doc": 1, "next_chunk": 0, "segments": []}
#: Segments are merged with an older one that is at most so many times as large as they are together.
RATIO = 2
#: Chunks for each file of blocks; and files at most.
PER_FILE, FILES = 50_000, 2_000


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def numbered(rows: DataFrame, key: str, name: str, after: int = 0, weight: str | None = None) -> DataFrame:
    """``rows`` with numbers in order of a key that is distinct: ``after`` + 1 and on, or, with a ``weight``, ``after`` + the weights before.

    Rows are dealt by a range exchange and numbered by the sizes of its parts, so that no task holds all of them."""
    each = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    cuts = written(rows.select(key, each.alias("_w")).repartitionByRange(key).select(key, "_w", F.spark_partition_id().alias("_part")), "numbers")
    sizes = cuts.groupBy("_part").agg(F.min(key).alias("_from"), F.sum("_w").alias("_size"))
    parts = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)))  # one row for each part
    within = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cuts.withColumn("_n", within).join(F.broadcast(parts.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    first = after if weight else after + 1
    return rows.join(placed.select(key, (F.lit(first) + F.col("_before") + F.col("_n")).cast("bigint").alias(name)), key)


@dataclass
class Segments:
    spark: SparkSession
    root: str
    tokens: object = stemmed_tokens

    def __post_init__(self):
        self.root = self.root.rstrip("/")

    def pointer(self) -> Pointer:
        return Pointer(self.spark, self.root, "meta")

    def manifest(self) -> tuple[int, dict]:
        version, meta = self.pointer().latest()
        return version, EMPTY | (meta or {})

    # -- reading -----------------------------------------------------------------------------------------------------

    def _read(self, name: str, segments: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{s['folder']}/{name}" for s in segments]
        return self.spark.read.schema(STORED[name]).parquet(*paths) if paths else self.spark.createDataFrame([], STORED[name])

    @staticmethod
    def _any(segments: list[dict], name: str) -> bool:
        return any(s[f"n_{name}"] for s in segments)

    def rows(self, meta: dict | None = None) -> DataFrame:
        """Live documents, with the number of the commit that wrote each row."""
        live = (meta or self.manifest()[1])["segments"]
        found = self._read("documents", live)
        return found.join(self._read("dropped", live), ["doc_id", "seq"], "left_anti") if self._any(live, "dropped") else found

    def documents(self) -> DataFrame:
        return self.rows().select(*names(DOCUMENTS))

    def _chunks(self, meta: dict, **also: Column) -> DataFrame:
        live = meta["segments"]
        found = self._read("chunks", live).withColumns(also)
        return found.join(self._read("killed", live), "chunk_id", "left_anti") if self._any(live, "killed") else found

    def chunks(self, **also: Column) -> DataFrame:
        """Live chunks; ``also`` are computed where they are read, so that a reader of these alone exchanges no texts."""
        return self._chunks(self.manifest()[1], **also).select(*names(CHUNKS), *also)

    def store(self) -> blocks.Store:
        """Blocks and figures for :class:`blocks.BlockSearch`."""
        meta = self.manifest()[1]
        live = meta["segments"]
        dead = self._read("killed", live) if self._any(live, "killed") else None
        return blocks.Store(self._read("blocks", live), float(meta["n_chunks"]), meta["n_tokens"] / max(meta["n_chunks"], 1), dead, self.tokens)

    def vectors(self, model: str) -> DataFrame:
        """(embedded, vec): vectors of this model by the hash of the text they stand for, of all stored chunks, dead ones too."""
        meta = self.manifest()[1]
        live = meta["segments"] if meta["embed_model"] == model else []
        return self._read("chunks", live).where("vec IS NOT NULL").select("embedded", "vec").dropDuplicates(["embedded"])

    # -- writing -----------------------------------------------------------------------------------------------------

    def _write(self, folder: str, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.select(*names(STORED[name])).write.mode("overwrite").parquet(f"{self.root}/{folder}/{name}")

    def _spread(self, found: DataFrame, n_chunks: int) -> DataFrame:
        """Blocks in order of their tokens, so that a reader of some tokens skips most row groups."""
        return found.repartitionByRange(max(1, min(FILES, n_chunks // PER_FILE)), "token").sortWithinPartitions("token", "block")

    def commit(self, documents: DataFrame, chunks: DataFrame, replaced: DataFrame, *, meta: dict, version: int, cut: DataFrame | None = None, fresh: bool = False) -> dict:
        """One more segment, and the manifest with it.

        ``documents`` (without seq) are new rows, ``chunks`` (doc_id, ord, heading, page, text, vec, embedded) those of new and changed documents, ``replaced``
        (doc_id) the documents whose old row goes; ``cut`` (doc_id) those whose old chunks go, by default the same. With ``fresh`` the segment replaces all others."""
        meta = dict(meta)
        older = [] if fresh else meta["segments"]
        seq, folder = meta["generation"] + 1, f"segment-{meta['generation'] + 1}-{uuid.uuid4().hex[:12]}"
        sized = numbered(chunks.groupBy("doc_id").agg((F.max("ord") + 1).alias("_n")), "doc_id", "_start", meta["next_chunk"], "_n")
        named = chunks.join(sized.select("doc_id", "_start"), "doc_id").withColumn("chunk_id", F.col("_start") + F.col("ord"))
        size = lambda c: F.coalesce(F.size(self.tokens(F.col(c))), F.lit(0))
        self._write(folder, documents=documents.withColumn("seq", F.lit(seq)), chunks=named.withColumn("d", size("text") + size("heading")))
        mine = {"folder": folder}
        new = self._read("chunks", [mine])
        n, tokens, last = new.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0)), F.max("chunk_id")).first()
        self._write(folder, blocks=blocks.built(new, self.tokens).sortWithinPartitions("token", "block"))
        was = {**meta, "segments": older}
        self._write(folder, dropped=self.rows(was).join(replaced.select("doc_id"), "doc_id", "left_semi"))
        dead = self._chunks(was).select("chunk_id", "doc_id", "d").join((replaced if cut is None else cut).select("doc_id").distinct(), "doc_id", "left_semi")
        dead = written(dead.select("chunk_id", "d"), "killed")
        self._write(folder, killed=dead)
        n_dead, d_dead = dead.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        n_dropped = self._read("dropped", [mine]).count()
        mine |= {"first_seq": seq, "first_chunk": meta["next_chunk"], "n_rows": n, "n_dropped": n_dropped, "n_killed": n_dead}
        base = {"n_chunks": 0, "n_tokens": 0} if fresh else meta
        top = self._read("documents", [mine]).agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        meta |= {
            "generation": seq, "segments": [*older, mine], "n_chunks": base["n_chunks"] + n - n_dead, "n_tokens": base["n_tokens"] + tokens - d_dead,
            "next_doc": max(meta["next_doc"], top + 1), "next_chunk": meta["next_chunk"] if last is None else last + 1,
        }
        self.pointer().write(meta, after=version)
        self.merge()
        return meta

    def due(self, segments: list[dict]) -> int:
        """How many of the newest segments to merge, 0 for none: older ones join while they are not much larger."""
        out, total = 0, 0
        for i in range(len(segments) - 1, -1, -1):
            size = max(segments[i]["n_rows"], 1)
            if i < len(segments) - 1 and size <= RATIO * total:
                out = len(segments) - i
            total += size
        if sum(s["n_killed"] for s in segments) * 2 > sum(s["n_rows"] for s in segments):  # most is dead
            out = len(segments)
        return out if out > 1 else 0

    def merge(self, most: int | None = None) -> int:
        """Merge the segments that are due, or the ``most`` newest; gives how many were merged."""
        version, meta = self.manifest()
        n = self.due(meta["segments"]) if most is None else min(most, len(meta["segments"]))
        if n:
            keep, group = meta["segments"][:-n], meta["segments"][-n:]
            inner = {**meta, "segments": group}
            seq, first_seq, first_chunk = meta["generation"] + 1, group[0]["first_seq"], group[0]["first_chunk"]
            folder = f"segment-{seq}-{uuid.uuid4().hex[:12]}"
            self._write(folder, documents=self.rows(inner), chunks=self._chunks(inner))
            mine = {"folder": folder, "first_seq": first_seq, "first_chunk": first_chunk}
            mine["n_rows"] = self._read("chunks", [mine]).count()
            found = blocks.unblocked(self._read("blocks", group))
            if self._any(group, "killed"):
                found = found.join(self._read("killed", group), "chunk_id", "left_anti")
            self._write(
                folder, blocks=self._spread(blocks.blocked(found), mine["n_rows"]),
                dropped=self._read("dropped", group).where(F.col("seq") < first_seq), killed=self._read("killed", group).where(F.col("chunk_id") < first_chunk),
            )
            mine |= {f"n_{t}": self._read(t, [mine]).count() for t in ("dropped", "killed")}
            self.pointer().write({**meta, "generation": seq, "segments": [*keep, mine]}, after=version)
        self.prune()
        return n

    def prune(self) -> list[str]:
        """Delete segments that no kept manifest names and that are not newer than these, as those may just be being written."""
        pointer = self.pointer()
        kept = [pointer.at(v) for v in pointer.versions()]
        if not kept:
            return []
        named, oldest = {s["folder"] for m in kept for s in m.get("segments", [])}, min(m.get("generation", 0) for m in kept)
        gone = []
        for status in pointer.fs.listStatus(pointer.path):
            name = status.getPath().getName()
            found = re.fullmatch(r"segment-(\d+)-\w+", name)
            if found and name not in named and int(found[1]) <= oldest:
                pointer.fs.delete(status.getPath(), True)
                gone.append(name)
        return gone
