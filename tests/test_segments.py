"""Block-max postings against plain BM25, and the segmented index against a rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import index_tokens
from tessera.operators import blocks, index, postings, retrieval, search_index, segments
from tessera.operators.pointer import Pointer

CHUNKS = "chunk_id bigint, text string, heading string"


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["error", "e-4471", "snake_case", "leave", "policy"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([3, 10, 40, 200]))), rnd.choice(["", "leave policy", "error", None])) for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "", ""), (n + 2, "w0 " * 3000, ""), (2**40, "e-4471 leave", "e 4471"), (-5, "policy w1", "")]


QUERIES = [(1, "w0 w1 w2"), (2, "error E-4471"), (3, "snake_case w50 policy policy"), (4, "of the"), (5, ""), (6, "nothing-like-this"), (7, "w64 leave w3 w3"), (8, "w0")]


def found(df):
    return {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize(("k", "span", "seeds"), [(5, 8, 1), (1000, 16, 3)])
def test_blocks_give_what_plain_bm25_gives(spark, monkeypatch, k, span, seeds):
    monkeypatch.setattr(blocks, "SPAN", span)
    monkeypatch.setattr(blocks, "SEEDS", seeds)
    chunks, queries = spark.createDataFrame(corpus(), CHUNKS), spark.createDataFrame(QUERIES, "query_id bigint, query string")
    search = blocks.BlockSearch(blocks.Store.build(chunks), queries, k)
    assert found(search.found) == found(retrieval.bm25_search(chunks, queries, k))


def test_blocks_below_the_threshold_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SPAN", 8)
    rows = [(i, "common words " + ("rare rare rare" if i in (3, 500) else "filler " * (5 + i % 7)), "") for i in range(800)]
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([(1, "rare common")], "query_id bigint, query string")
    search = blocks.BlockSearch(blocks.Store.build(chunks), queries, 2)
    assert found(search.found) == found(retrieval.bm25_search(chunks, queries, 2))
    row = search.share().first()
    assert row.n_scored < 0.2 * row.n_blocks


def test_entries_and_back(spark):
    chunks = spark.createDataFrame([(7, "b a b", "a"), (8, "", None)], CHUNKS)
    each = {(r.chunk_id, r.token): (r.d, r.places) for r in postings.entries(chunks).collect()}
    assert each == {(7, "a"): (4, [1, 2]), (7, "b"): (4, [0, 4])}
    again = {(r.chunk_id, r.token): (r.d, r.places) for r in blocks.unblocked(blocks.blocked(postings.entries(chunks))).collect()}
    assert again == each
    row = blocks.blocked(postings.entries(chunks)).where("token = 'a'").first()
    assert (row.n, row.most, row.least, row.fs) == (1, 3, 4, [3])  # a heading counts twice


def test_blocks_are_built_with_one_exchange_of_the_texts(spark, monkeypatch):
    chunks = spark.createDataFrame(corpus(), CHUNKS)
    made = blocks.built(chunks)
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(span" in plan.replace("#", " ").replace("Exchange hashpartitioning(span ", "Exchange hashpartitioning(span")
    plain = lambda df: sorted(map(str, df.select(*blocks.COLUMNS).collect()))
    want = plain(blocks.blocked(postings.entries(chunks)))
    assert plain(made) == want
    monkeypatch.setattr(blocks, "PLAIN", {})
    assert plain(blocks.built(chunks)) == want


def test_empty_corpus_and_no_queries(spark):
    none, one = spark.createDataFrame([], CHUNKS), spark.createDataFrame([(1, "a", "")], CHUNKS)
    asked = spark.createDataFrame([(1, "word a")], "query_id bigint, query string")
    for chunks, queries in ((none, asked), (one, asked.limit(0))):
        assert blocks.BlockSearch(blocks.Store.build(chunks), queries).found.count() == 0
        assert retrieval.bm25_search(chunks, queries).count() == 0


def test_many_query_tokens_take_all_postings(spark, monkeypatch):
    chunks, queries = spark.createDataFrame(corpus(50), CHUNKS), spark.createDataFrame(QUERIES, "query_id bigint, query string")
    some = found(retrieval.bm25_search(chunks, queries, 9))
    monkeypatch.setattr(postings, "LARGEST", 16)
    assert found(retrieval.bm25_search(chunks, queries, 9)) == some


# -- segments --------------------------------------------------------------------------------------------------------


def store_of(spark, tmp_path):
    return segments.Segments(spark, f"file://{tmp_path}/segments", index_tokens)


def put(ix, docs, gone=()):
    """Documents (id, chunk texts) written, others deleted, in one commit."""
    spark = ix.spark
    version, meta = ix.manifest()
    new = spark.createDataFrame([(i, f"/d/{i}", f"t{i}", ".md", 1, 1.0, "h", len(c)) for i, c in docs], segments.DOCUMENTS)
    cut = spark.createDataFrame([(i, n, "", None, t, [1.0, float(n)], t) for i, c in docs for n, t in enumerate(c)], "doc_id bigint, ord int, heading string, page int, text string, vec array<float>, embedded string")
    replaced = spark.createDataFrame([(i,) for i in [*(i for i, _ in docs), *gone]], "doc_id bigint")
    return ix.commit(new, cut, replaced, meta=meta, version=version)


def plain_search(spark, state, queries, k=10):
    """BM25 over the live texts as one table; ids of chunks are (document, place) here."""
    rows = [(i * 1000 + n, t, "") for i, c in state.items() for n, t in enumerate(c)]
    got = retrieval.bm25_search(spark.createDataFrame(rows, CHUNKS), queries, 1000)
    return sorted((r.query_id, round(r.score, 6), r.chunk_id) for r in got.collect())


def search(ix, queries):
    hits = blocks.BlockSearch(ix.store(), queries, 1000).found.join(ix.chunks().select("chunk_id", "doc_id", "ord"), "chunk_id")
    return sorted((r.query_id, round(r.score, 6), r.doc_id * 1000 + r.ord) for r in hits.collect())


def test_segments_equal_a_rebuild_after_every_commit(spark, tmp_path):
    rnd, ix, state = random.Random(2), store_of(spark, tmp_path), {}
    words = [f"w{i}" for i in range(20)] + ["e-4471"]
    text = lambda: [" ".join(rnd.choices(words, k=rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 4))]
    queries = spark.createDataFrame([(1, "w0 w1"), (2, "e-4471 w5")], "query_id bigint, query string")
    steps = [({i: text() for i in range(40)}, []), ({3: text(), 41: text()}, []), ({}, [4, 5]), ({3: text()}, [41]), ({50: text()}, []), ({3: [], 51: text()}, [])]
    for at, (docs, gone) in enumerate(steps):
        put(ix, docs.items(), gone)
        state = {i: c for i, c in (state | docs).items() if i not in gone}
        assert sorted(r.doc_id for r in ix.documents().collect()) == sorted(state)
        assert sorted((r.doc_id, r.ord, r.text) for r in ix.chunks().collect()) == sorted((i, n, t) for i, c in state.items() for n, t in enumerate(c))
        meta = ix.manifest()[1]
        assert (meta["n_chunks"], meta["n_tokens"]) == (sum(map(len, state.values())), sum(len(t.replace("-", " ").split()) for c in state.values() for t in c))
        if at in (2, 5):
            assert search(ix, queries) == plain_search(spark, state, queries)
    assert 1 < len(ix.manifest()[1]["segments"]) < len(steps)  # some were merged, the large first one stayed
    ix.merge(most=99)
    meta = ix.manifest()[1]
    assert len(meta["segments"]) == 1 and meta["segments"][0]["n_killed"] == 0 and search(ix, queries) == plain_search(spark, state, queries)


def folders(tmp_path):
    return {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (tmp_path / "segments").glob("segment-*")}


def test_what_is_written_follows_what_changed_and_old_segments_go(spark, tmp_path):
    ix = store_of(spark, tmp_path)
    rnd = random.Random(3)
    put(ix, [(i, [" ".join(f"x{rnd.randrange(10**6)}" for _ in range(200)) for _ in range(3)]) for i in range(60)])
    large = sum(folders(tmp_path).values())
    before = set(folders(tmp_path))
    put(ix, [(5, ["something else"])])
    added = {k: v for k, v in folders(tmp_path).items() if k not in before}
    assert before <= set(folders(tmp_path)) and sum(added.values()) < 0.1 * large
    for i in range(4):
        put(ix, [(6, [f"again {i}"])])
    named = {s["folder"] for s in ix.manifest()[1]["segments"]}
    assert named <= set(folders(tmp_path)) and len(folders(tmp_path)) <= len(named) + 8
    assert len(named) <= 4 and before <= named


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    ix = store_of(spark, tmp_path)
    put(ix, [(1, ["one text"]), (2, ["two texts"])])
    version, meta = ix.manifest()
    with monkeypatch.context() as m:
        m.setattr(Pointer, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            put(ix, [(1, ["changed"])], [2])
    assert ix.manifest() == (version, meta) and sorted(r.text for r in ix.chunks().collect()) == ["one text", "two texts"]
    put(ix, [(1, ["changed"])], [2])
    assert [r.text for r in ix.chunks().collect()] == ["changed"]


def test_of_two_writers_from_one_version_one_fails(spark, tmp_path):
    ix = store_of(spark, tmp_path)
    version, meta = ix.manifest()
    put(ix, [(1, ["first"])])
    none = spark.createDataFrame([], f"{segments.CHUNKS}, embedded string")
    with pytest.raises(OSError, match="changed by another"):
        ix.commit(spark.createDataFrame([], segments.DOCUMENTS), none, spark.createDataFrame([(1,)], "doc_id bigint"), meta=meta, version=version)
    assert ix.documents().count() == 1


@pytest.mark.parametrize(("sizes", "merged"), [([100], 0), ([100, 1], 0), ([100, 1, 1], 2), ([3, 2], 2), ([100, 10, 4, 2], 3), ([5, 5, 5], 3)])
def test_merge_policy(spark, tmp_path, sizes, merged):
    assert store_of(spark, tmp_path).due([{"n_rows": n, "n_killed": 0} for n in sizes]) == merged


def test_numbers_of_weights(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 4).alias("w")).repartition(5)
    got = {r.k: r.at for r in segments.numbered(df, "k", "at", 10, "w").collect()}
    assert got == {k: 10 + sum(j % 4 for j in range(k)) for k in range(100)}


def test_nothing_is_embedded_twice_and_reindex_swaps(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    for i in range(5):
        (corpus / f"f{i}.md").write_text(f"# Title {i}\n\nSome words about matter{i} that are long enough.\n")
    ix = index.Index(spark, f"file://{tmp_path}/index")
    assert ix.ingest([str(corpus)])["embedded"] == 5
    (corpus / "f0.md").rename(corpus / "moved.md")
    moved = ix.rescan()
    assert (moved["added"], moved["removed"], moved["embedded"]) == (1, 1, 0)
    again = ix.reindex()
    assert (again["added"], again["embedded"]) == (5, 0) and len(ix.manifest()[1]["segments"]) == 1 and ix.chunks().count() == 5

    def failing(text):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError, match="no model"):
        ix.reindex(model="other", embedder=failing)
    assert ix.chunks().count() == 5 and ix.meta()["embed_model"] == "hash-test"  # readers never lost the index
    assert ix.reindex(model="other")["embedded"] == 5 and ix.meta()["embed_model"] == "other"
    kept = spark.range(3).persist()
    kept.count()
    ix.rescan(model="other")
    assert kept.storageLevel.useMemory  # the caller's caches are left alone
    hits = search_index.ask(ix, "what of matter3", counted=True)
    assert hits.hits[0]["path"].endswith("f3.md") and {"dense_ms", "bm25_ms", "rerank_ms"} <= hits.timings.keys() and hits.counts["returned"] == len(hits.hits)
