"""Postings within the rows of their chunks: each distinct token of a chunk with its places, without an exchange."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.porter import stemmed_tokens, stemmed_tokens_of
from tessera.operators.scratch import written

ENTRIES = "array<struct<token:string,places:array<int>>>"


def _placed(tokens: Column, field: int) -> Column:
    """(token, place) of each token."""
    each = lambda t, i: F.struct(t.alias("token"), (2 * i + field).alias("at"))
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), each)


def rows(chunks: DataFrame, *also: str, tokens=T.index_tokens) -> DataFrame:
    """(chunk_id, d, entries) for each chunk, and the columns ``also``: entries hold its distinct tokens with their places.

    A place is twice the position, and one more in the heading; ``d`` is the number of all tokens in text and heading."""
    both = chunks.select(*also, "chunk_id", tokens(F.col("text")).alias("_t"), tokens(F.col("heading")).alias("_h"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    found = F.sort_array(F.concat(_placed(F.col("_t"), 0), _placed(F.col("_h"), 1)))
    sized = both.select(*also, "chunk_id", (size("_t") + size("_h")).alias("d"), found.alias("_all")).withColumn("_n", F.size("_all"))
    at = lambda i: F.get(F.col("_all"), i)
    first = lambda i: (i == 0) | (at(i)["token"] != at(i - 1)["token"])
    starts = F.when(F.col("_n") > 0, F.filter(F.sequence(F.lit(0), F.col("_n") - 1), first)).otherwise(F.array().cast("array<int>"))
    own = lambda s, k: F.sequence(s, F.coalesce(F.get(F.col("_starts"), k + 1), F.col("_n")) - 1)  # noqa: E731  slices would copy the whole array each
    each = F.transform("_starts", lambda s, k: F.struct(at(s)["token"].alias("token"), F.transform(own(s, k), lambda i: at(i)["at"]).alias("places")))
    return sized.withColumn("_starts", starts).select(*also, "chunk_id", "d", each.cast(ENTRIES).alias("entries"))


def entries(chunks: DataFrame, *, tokens=T.index_tokens) -> DataFrame:
    """(chunk_id, d, token, places) with a row for each distinct token of a chunk; no exchange."""
    # inline would infer a filter on the entries, which Catalyst pushes below the steps that make them: once more for each token
    return rows(chunks, tokens=tokens).select("chunk_id", "d", F.inline_outer("entries")).where("token IS NOT NULL")


def weight(places: Column) -> Column:
    """How much a token counts in a chunk: once for each place in the text, twice for one in the heading."""
    return F.size(places) + F.size(F.filter(places, lambda p: p % 2 == 1))


def phrase_entries(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """(token, chunk_id, d, places) of phrases (term, parts) as tokens of their own: neighbouring tokens of one field.

    ``phrases`` are of queries, and few: they are broadcast."""
    parts = F.broadcast(phrases.select("term", F.size("parts").alias("m"), F.posexplode("parts").alias("k", "token")))
    each = found.join(parts, "token").select("term", "m", "chunk_id", "d", F.explode("places").alias("p"), "k")
    starts = each.select("term", "m", "chunk_id", "d", (F.col("p") - 2 * F.col("k")).alias("at"))
    whole = starts.groupBy("term", "m", "chunk_id", "d", "at").agg(F.count("*").alias("n")).where("n = m")
    return whole.groupBy(F.col("term").alias("token"), "chunk_id", "d").agg(F.collect_list("at").alias("places"))


def terms_of(queries: DataFrame, tokens=T.index_tokens) -> DataFrame:
    """(query_id, term, parts, token) of the queries' terms, written once. A term that the index splits is a phrase and a token of
    its own: it holds what tokens do not."""
    terms = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term")).select("query_id", "term", tokens(F.col("term")).alias("parts"))
    key = F.when(F.size("parts") > 1, F.col("term")).otherwise(F.get("parts", 0))
    return written(terms.where(F.size("parts") > 0).withColumn("token", key), "terms")


@dataclass
class Prepared:
    """What a set of queries needs of a corpus: (chunk_id, d, entries) of all chunks with at least the queries' tokens.

    With ``whole``, phrases are among the entries as tokens of their own."""

    kept: DataFrame
    whole: bool = False

    def entries(self) -> DataFrame:
        return self.kept.select("chunk_id", "d", F.inline("entries"))

    def figures(self) -> Column:
        """Number of chunks and their mean length, as one value."""
        return self.kept.agg(F.struct(F.count("*").cast("double").alias("n_chunks"), F.avg("d").alias("avg_tokens")).alias("s")).scalar()

    def of(self, terms: DataFrame) -> DataFrame:
        """Entries of the terms' tokens, phrases among them."""
        found = self.entries()
        if self.whole:
            return found
        long = terms.where(F.size("parts") > 1).select("term", "parts").distinct()
        return found if long.isEmpty() else found.unionByName(phrase_entries(found, long))


#: The same tokens of a text within a Python pass.
PLAIN = {T.index_tokens: T.tokens_of, stemmed_tokens: stemmed_tokens_of}


def _picked(sent, tokens):
    """(chunk_id, d, entries) of the tokens and phrases in a broadcast (tokens, phrases by their first part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, phrases = sent.value
        for b in batches:
            for at in range(0, b.num_rows, PICKED):
                part = b.slice(at, PICKED)
                sizes, names, counts, flat, each = [], [], [], [], []
                for texts in zip(part.column(1), part.column(2), strict=True):
                    found: dict[str, list[int]] = {}
                    n = 0
                    for field, text in enumerate(texts):
                        said = tokens(text.as_py())
                        n += len(said)
                        for i in [i for i, t in enumerate(said) if t in wanted]:
                            found.setdefault(t := said[i], []).append(2 * i + field)
                            for term, parts in phrases.get(t, ()):
                                if said[i : i + len(parts)] == parts:
                                    found.setdefault(term, []).append(2 * i + field)
                    sizes.append(n)
                    each.append(len(found))
                    for token, places in found.items():
                        names.append(token)
                        counts.append(len(places))
                        flat.extend(places)
                ends = lambda lengths: pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32))
                places = pa.ListArray.from_arrays(ends(counts), pa.array(flat, pa.int32()))
                entries = pa.StructArray.from_arrays([pa.array(names, pa.string()), places], names=["token", "places"])
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends(each), entries)], names=["chunk_id", "d", "entries"])

    return run


def prepared(chunks: DataFrame, *queries: DataFrame, tokens=T.index_tokens) -> Prepared:
    """One pass over the texts: the queries' tokens and phrases are picked within the rows of the chunks and written, with the lengths.

    More than ``LARGEST`` terms are not sent to the tasks: all tokens are kept then, as for tokens that have no Python form."""
    asked = functools.reduce(DataFrame.unionByName, [q.select("query") for q in queries])
    terms = asked.select(F.explode(T.query_terms(F.col("query"))).alias("term")).distinct().select("term", tokens(F.col("term")).alias("parts"))
    found = [(r[0], list(r[1])) for r in terms.limit(LARGEST + 1).collect()] if tokens in PLAIN else []
    if tokens not in PLAIN or len(found) > LARGEST:
        return Prepared(written(rows(chunks, tokens=tokens), "postings"))
    phrases: dict[str, list] = {}
    for term, parts in found:
        if len(parts) > 1:
            phrases.setdefault(parts[0], []).append((term, parts))
    sent = chunks.sparkSession.sparkContext.broadcast((frozenset(p for _, parts in found for p in parts), phrases))
    picked = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "text", "heading").mapInArrow(_picked(sent, PLAIN[tokens]), f"chunk_id bigint, d int, entries {ENTRIES}")
    return Prepared(written(picked, "postings"), True)


#: Terms that travel to the tasks at most, and chunks whose entries a task holds at once.
LARGEST, PICKED = 1 << 18, 256
