"""Questions put to a stored index: what the command line and the HTTP adapter share."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.backends import HASH_MODEL, CrossEncoder, NeuralEmbedder, chosen, embed, vectors
from tessera.operators import blocks, context, retrieval
from tessera.operators.index import Index
from tessera.operators.scratch import written


@dataclass(frozen=True)
class Models:
    """What embeds texts and what reranks hits, as functions of columns or a model; with the embedder's name."""

    name: str = HASH_MODEL
    documents: Callable[[Column], Column] = embed
    queries: Callable[[Column], Column] = embed
    reranker: object = retrieval.lexical_score

    @classmethod
    def named(cls, embedder: str = "", reranker: str = "") -> Models:
        """The models of these names where they can be loaded; else the stand-ins."""
        scorer = chosen(CrossEncoder(reranker) if reranker else None) or retrieval.lexical_score
        neural = chosen(NeuralEmbedder(embedder) if embedder else None)
        if neural is None:
            return cls(reranker=scorer)
        return cls(neural.name, lambda c: vectors(c, neural), lambda c: vectors(c, neural, queries=True), scorer)


@dataclass
class Result:
    hits: list[Row]
    timings: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


def plan(ix: Index, questions: DataFrame, top_k: int = 0, *, models: Models = Models(), expand: bool = False, hold=None) -> retrieval.Search:
    """The search of a batch (query_id, query) over stored chunks and blocks of postings."""
    with_vec = lambda q: q.withColumn("vec", models.queries(F.col("query")))
    store = ix.store()
    return retrieval.Search(
        ix.chunks(), ix.documents().select("doc_id", "path", "title"), with_vec(questions), top_k=top_k, reranker=models.reranker, expand=expand, tokens=ix.tokens,
        embed=with_vec, lexical=lambda q, k: blocks.BlockSearch(store, q, k).found, hold=hold,
    )


def ask(ix: Index, question: str, top_k: int = 0, *, counted: bool = False, **options) -> Result:
    """Hits of one question in order of rank; with ``counted``, what each step left and how long it took (in milliseconds).

    Every step is computed once: with ``counted`` it is written, and later ones read it."""
    questions = ix.spark.createDataFrame([(0, question)], "query_id bigint, query string")
    start, out = time.perf_counter(), Result([])

    def hold(name: str, step: DataFrame) -> DataFrame:
        began = time.perf_counter()
        kept = written(step, name)
        key = f"{name.split('_')[0]}_ms"  # both lists of clauses count as one step
        out.timings[key] = out.timings.get(key, 0.0) + 1000 * (time.perf_counter() - began)
        return kept

    search = plan(ix, questions, top_k, hold=hold if counted else None, **options)
    out.hits = retrieval.project(search.found).orderBy("rank").collect()
    out.timings["search_ms"] = 1000 * (time.perf_counter() - start)
    if counted:
        out.counts = {k: v for k, v in search.counts().first().asDict().items() if k != "query_id"}
    return out


def sources(ix: Index, hits: list[Row]) -> str:
    """The context of an answer from hits."""
    rows = ix.spark.createDataFrame([(0, h["rank"], h["chunk_id"], h["label"], h["text"]) for h in hits], "query_id bigint, rank int, chunk_id bigint, label string, text string")
    packed = context.pack_sources(rows).first()
    return packed["context"] if packed else ""


def answer(ix: Index, question: str, model, top_k: int = 0, past: list[dict] = (), **options):
    """Events of an answer; see :func:`context.answer_events`."""
    hits = ask(ix, question, top_k, **options).hits
    yield from context.answer_events(question, sources(ix, hits) if hits else "", [h["label"] for h in hits], model, list(past))
