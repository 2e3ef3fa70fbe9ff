"""The index over files: what changed is found by joins, and only that is read, parsed, embedded and written.

Documents, chunks, postings and vectors are kept in segments (:mod:`tessera.operators.segments`). Incremental ingest reads only what size
and time of a file do not settle, and parses only what its content does not; texts that were embedded before keep their vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.backends import HASH_MODEL, embed
from tessera.functions import text as T
from tessera.operators.chunking import chunk_documents
from tessera.operators.scratch import written
from tessera.operators.segments import CHUNKS, DOCUMENTS, STORED, Segments, names, numbered
from tessera.sources.loaders import contents, extension, list_files, load_files, title_of

#: Files up to which contents are read by name.
BY_NAME = 5_000


def change_status(listed_bytes: Column, listed_mtime: Column, sha: Column, stored: str = "stored") -> Column:
    """'unchanged' by size and time, 'touched' if only the content is the same, else 'parse'; what has no chunks is parsed again."""
    s = lambda c: F.col(f"{stored}.{c}")
    whole = s("n_chunks") > 0
    same = whole & (s("bytes") == listed_bytes) & (F.abs(s("mtime") - listed_mtime) < 1e-6)
    return F.when(F.coalesce(same, F.lit(False)), "unchanged").when(F.coalesce(whole & (s("sha256") == sha), F.lit(False)), "touched").otherwise("parse")


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's content, in hexadecimal digits."""
    return F.sha2(content, 256)


def remembered(old: Column, new: Column) -> Column:
    """Roots that are remembered after these are given: each once, sorted."""
    return F.array_sort(F.array_union(old, new))


def refresh_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The documents with n_chunks as the chunks (doc_id, ...) say."""
    n = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("_n"))
    return documents.drop("n_chunks").join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("_n", F.lit(0))).drop("_n")


def upsert(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, path, columns) of all documents: new ones by path in place of old ones, whose ids they keep.

    Documents that were not known are numbered in order of path after the highest id. Numbers are dealt by a range exchange and
    the sizes of its parts, so that no task holds all of them."""
    fresh = new.select("path", *columns).join(old.select("path", "doc_id"), "path", "left")
    stay = old.join(new.select("path"), "path", "left_anti").select("doc_id", "path", *columns)
    known = fresh.where("doc_id IS NOT NULL").select("doc_id", "path", *columns)
    top = int(old.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0])
    added = numbered(fresh.where("doc_id IS NULL").drop("doc_id"), "path", "doc_id", top).select("doc_id", "path", *columns)
    return stay.unionByName(known).unionByName(added)


def delete(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the documents ``gone`` (doc_id)."""
    ids = gone.select("doc_id").distinct()
    return documents.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def under(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def prune(documents: DataFrame, seen: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """Documents that go: under a root, not seen in this run, and no longer listed at all."""
    within = F.lit(False)
    for root in roots:
        within = within | under(F.col("path"), root)
    gone = documents.where(within).join(seen.select("path").distinct(), "path", "left_anti")
    return gone.join(listing.select("path").distinct(), "path", "left_anti")


def forget(documents: DataFrame, target: str, *, whole_folders: bool = False) -> DataFrame:
    """The documents that stay when a path or a prefix is forgotten. As a plain prefix /docs also forgets /docs2, unless
    ``whole_folders``."""
    hit = under(F.col("path"), target) if whole_folders else F.lower("path").startswith(target.lower())
    return documents.where(~hit)


def report(actions: DataFrame) -> DataFrame:
    """One row of counters from (action, n_chunks)."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(*[count(a) for a in ("added", "updated", "unchanged", "skipped", "failed")], F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("bigint").alias("chunks"))


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, bytes, chunks."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    each = documents.select(one.alias("d"), F.col("bytes").cast("bigint").alias("b"), zero.alias("c")).unionAll(chunks.select(zero.alias("d"), zero.alias("b"), one.alias("c")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return each.agg(total("d").alias("documents"), total("b").alias("bytes"), total("c").alias("chunks"))


def composite(documents: DataFrame, chunks: DataFrame, meta: dict, rerank_model: str | None = None) -> DataFrame:
    """One row: the figures of :func:`stats`, the size of the vectors, the models, and the remembered roots."""
    size = chunks.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dims")).scalar()
    roots = F.array(*[F.lit(r) for r in meta["roots"]]) if meta["roots"] else F.array().cast("array<string>")
    told = {"embed_model": meta["embed_model"], "rerank_model": rerank_model}
    return stats(documents, chunks).withColumns({"dims": size, "roots": roots, **{k: F.lit(v).cast("string") for k, v in told.items()}})


def by_extension(documents: DataFrame) -> DataFrame:
    return documents.groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


@dataclass
class Index(Segments):
    """An index of files in a folder."""

    def meta(self) -> dict:
        return self.manifest()[1]

    def check_model(self, name: str) -> None:
        stored = self.meta()["embed_model"]
        if stored and stored != name:
            raise RuntimeError(f"the index was built with {stored}, not {name}: reindex")

    def _listing(self, roots: list[str]) -> tuple[DataFrame, list[str]]:
        """(path, bytes, mtime, status) of the files under the roots, and the roots that do not exist."""
        listing = self.spark.createDataFrame([], "path string, bytes bigint, mtime double, status string")
        missing = []
        for root in sorted(roots):
            try:
                listing = listing.unionByName(list_files(self.spark, root))
            except FileNotFoundError:
                missing.append(root)
        return listing, missing

    def _contents(self, files: DataFrame, roots: list[str]) -> DataFrame:
        """The files with their content. Few are read by name; of many, the roots are read and joined."""
        names = [r[0] for r in files.select("path").limit(BY_NAME + 1).collect()]
        if not names:
            return files.withColumn("content", F.lit(None).cast("binary"))
        return files.join(contents(self.spark, names if len(names) <= BY_NAME else roots).dropDuplicates(["path"]), "path")

    def _embedded(self, titled: DataFrame, model: str, embedder) -> tuple[DataFrame, int]:
        """Chunks with their vectors, and how many were embedded: texts that this model has seen keep theirs."""
        text = T.embed_text(F.col("title"), F.col("heading"), F.col("text"))
        hashed = titled.withColumn("_text", text).withColumn("embedded", F.sha2("_text", 256))
        known = written(hashed.join(self.vectors(model), "embedded", "left"), "vectors")
        new = known.where("vec IS NULL").drop("vec")
        once = written(new.select("embedded", "_text").dropDuplicates(["embedded"]).select("embedded", embedder(F.col("_text")).alias("vec")), "embedded")
        out = known.where("vec IS NOT NULL").unionByName(new.join(once, "embedded").select(*known.columns))
        return out.select("doc_id", "ord", "heading", "page", "text", "vec", "embedded"), once.count()

    def ingest(self, roots: list[str], *, force: bool = False, prune_missing: bool = True, model: str = HASH_MODEL, embedder=embed) -> dict:
        """Bring the index up to date with the files under the roots; counters of what was done.

        Size and time of a file settle most; only what differs in them is read, and only what differs in its content is parsed. A run
        that changes nothing writes nothing but the roots."""
        if not roots:
            raise RuntimeError("no folders are remembered: name some to ingest")
        self.check_model(model)
        version, meta = self.manifest()
        given = lambda names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        known = list(self.spark.range(1).select(remembered(given(meta["roots"]), given(roots))).first()[0])
        if known != meta["roots"] or meta["embed_model"] != model:  # remembered before any work
            meta = meta | {"roots": known, "embed_model": model}
            version = self.pointer().write(meta, after=version)
        return self._bring(roots, meta, version, force=force, prune_missing=prune_missing, model=model, embedder=embedder)

    def _bring(self, roots: list[str], meta: dict, version: int, *, force: bool, prune_missing: bool, model: str, embedder, fresh: bool = False) -> dict:
        listing, missing = self._listing(roots)
        there = [r for r in roots if r not in missing]
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        try:
            listing = hold(listing)
            old = hold(self.spark.createDataFrame([], STORED["documents"]) if fresh else self.rows(meta))
            ok = listing.where("status = 'ok'").dropDuplicates(["path"]).drop("status")
            joined = ok.alias("file").join(old.alias("stored"), F.col("file.path") == F.col("stored.path"), "left")
            first_look = F.lit("parse") if force else change_status(F.col("file.bytes"), F.col("file.mtime"), F.lit(None).cast("string"))
            settled = hold(joined.select("file.*", F.col("stored.sha256").alias("had"), F.col("stored.n_chunks").alias("n_chunks"), first_look.alias("change")))
            doubtful = self._contents(settled.where("change = 'parse'").drop("change"), there).withColumn("sha256", content_hash(F.col("content")))
            same = F.lit(False) if force else F.coalesce((F.col("n_chunks") > 0) & (F.col("had") == F.col("sha256")), F.lit(False))
            doubtful = hold(doubtful.withColumn("change", F.when(same, "touched").otherwise("parse")).drop("had", "n_chunks"))
            loaded = hold(load_files(doubtful.where("change = 'parse'")))
            ready = doubtful.where("change = 'parse'").drop("content", "change").join(loaded.where("error IS NULL"), "path")
            cut = hold(chunk_documents(ready.select(F.col("path").alias("doc_id"), "blocks")).withColumnRenamed("doc_id", "path"))
            first = F.coalesce(F.try_element_at(F.col("blocks"), F.lit(1))["text"], F.lit(""))
            counts = cut.groupBy("path").agg(F.count("*").cast("int").alias("n_chunks"))
            columns = names(DOCUMENTS)[2:]
            parsed = hold(ready.select("path", title_of(first, F.col("path")).alias("title"), extension(F.col("path")).alias("ext"), "bytes", "mtime", "sha256").join(counts, "path"))
            touched = doubtful.where("change = 'touched'").select("path", F.col("bytes").alias("_b"), F.col("mtime").alias("_m"))
            again = old.join(touched, "path").withColumn("bytes", F.col("_b")).withColumn("mtime", F.col("_m")).select("doc_id", "path", *columns)
            gone = hold(prune(old, ok, listing, there) if prune_missing and not fresh else old.limit(0))
            known = parsed.join(old.select("path", "doc_id"), "path")
            added = numbered(parsed.join(old.select("path"), "path", "left_anti"), "path", "doc_id", meta["next_doc"] - 1)
            new = hold(known.select("doc_id", "path", *columns).unionByName(added.select("doc_id", "path", *columns)))
            n = lambda df: df.count()
            out = {"added": n(added), "updated": n(known), "unchanged": n(settled.where("change = 'unchanged'")) + n(again), "failed": n(loaded.where("error IS NOT NULL")), "removed": n(gone), "chunks": n(cut), "embedded": 0, "missing": missing}
            out["skipped"] = n(listing.where("status IN ('unsupported', 'oversize')")) + n(ready) - out["added"] - out["updated"]
            out["failures"] = [(r[0], r[1]) for r in loaded.where("error IS NOT NULL").select("path", "error").orderBy("path").limit(100).collect()]
            if fresh or out["added"] or out["updated"] or out["removed"] or not again.isEmpty():
                chunks, out["embedded"] = self._embedded(cut.join(new.select("path", "doc_id", "title"), "path"), model, embedder)
                changed = known.select("doc_id").unionByName(gone.select("doc_id"))
                self.commit(new.unionByName(again), chunks, changed.unionByName(again.select("doc_id")), cut=changed, meta=meta, version=version, fresh=fresh)
            return out
        finally:
            for df in held:
                df.unpersist()

    def rescan(self, **options) -> dict:
        return self.ingest(self.meta()["roots"], **options)

    def reindex(self, *, model: str = HASH_MODEL, embedder=embed) -> dict:
        """Build anew from the remembered roots, with a new model if need be. Readers see the old index until the new one is whole;
        texts that the same model has embedded are not embedded again."""
        version, meta = self.manifest()
        if not meta["roots"]:
            raise RuntimeError("no folders are remembered: name some to ingest")
        return self._bring(meta["roots"], meta | {"embed_model": model}, version, force=True, prune_missing=True, model=model, embedder=embedder, fresh=True)

    def forget(self, target: str, **options) -> int:
        version, meta = self.manifest()
        old = self.rows(meta)
        gone = written(old.join(forget(old, target, **options).select("doc_id"), "doc_id", "left_anti").select("doc_id"), "forgotten")
        removed = gone.count()
        if removed:
            roots = [r for r in meta["roots"] if not r.lower().startswith(target.lower())]
            none = self.spark.createDataFrame([], f"{CHUNKS}, embedded string")
            self.commit(self.spark.createDataFrame([], DOCUMENTS), none, gone, meta=meta | {"roots": roots}, version=version)
        return removed
