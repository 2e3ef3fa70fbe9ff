import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions.porter import stemmed_tokens
from tessera.operators import context, evaluate, retrieval


def hits(spark, scores, docs=None):
    rows = [(1, i, (docs or [0] * len(scores))[i], float(s), i + 1) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, doc_id bigint, score double, rank int")


@pytest.mark.parametrize(("scores", "margin", "minimum", "kept"), [([-2.2, -11, -12, -15], 6, 0, 1), ([4.0, 3.1, 1.0], 6, 0, 3), ([-30, -31], 6, 5, 1), ([0, -99], 0, 0, 2)])
def test_floor(spark, scores, margin, minimum, kept):
    assert retrieval.floor(hits(spark, scores), margin, minimum).count() == kept


def test_cap_demotes_and_keeps(spark):
    out = [r.doc_id for r in retrieval.cap(hits(spark, range(6, 0, -1), [1, 1, 1, 1, 1, 2]), 2).orderBy("rank").collect()]
    assert out == [1, 1, 2, 1, 1, 1]


def test_fusion_prefers_what_both_lists_have_and_the_first_list_on_ties(spark):
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "query_id bigint, chunk_id bigint, rank int") for x in ([10, 20, 30], [40, 10, 50])]
    out = [r.chunk_id for r in retrieval.fuse([(x, 1.0) for x in lists]).orderBy("rank").collect()]
    assert out == [10, 40, 20, 30, 50]


def test_dense(spark):
    chunks = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(3)]) for i in range(3)], "chunk_id bigint, vec array<float>")
    queries = spark.createDataFrame([(7, [0.0, 1.0, 0.0])], "query_id bigint, vec array<float>")
    first = retrieval.dense_search(chunks, queries, 3).orderBy("rank").first()
    assert (first.chunk_id, first.score) == (1, 1.0)
    with pytest.raises(Exception, match="reindex"):
        retrieval.dense_search(chunks, spark.createDataFrame([(7, [0.0] * 8)], "query_id bigint, vec array<float>"), 3).collect()
    assert retrieval.dense_search(chunks.limit(0), queries).count() == 0


def test_stemmed_bm25_matches_sqlite(spark):
    rnd = random.Random(3)
    words = "leave leaving policy policies error e-4471 snake_case running runs holiday Été naïve expenses claim claims limit".split()
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(3, 40))), " ".join(rnd.choices(words, k=2))) for i in range(1, 61)]
    queries = [(1, "leave policy"), (2, "error E-4471"), (3, "snake_case runs"), (4, "claims limit expenses holiday")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, heading, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, text, heading) values (?, ?, ?)", rows)
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string, heading string")
    found = retrieval.bm25_search(chunks, spark.createDataFrame(queries, "query_id bigint, query string"), 100, tokens=stemmed_tokens)
    got = {(r.query_id, r.chunk_id): r.score for r in found.collect()}
    from tessera.functions.text import query_terms

    want = {}
    for q, text in queries:
        terms = spark.range(1).select(query_terms(F.lit(text))).first()[0]
        for rowid, score in db.execute("select rowid, -bm25(f, 1.0, 2.0) from f where f match ?", [" OR ".join(f'"{t}"' for t in terms)]):
            want[q, rowid] = score
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


@pytest.mark.parametrize("cells", [1 << 20, 7])
def test_scores_within_rows_are_those_of_joins_and_exchange_little(spark, monkeypatch, cells):
    from tessera.operators import postings

    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    rnd = random.Random(5)
    words = "leave policy error e-4471 snake_case claims Été limit the".split()
    chunks = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 30))), rnd.choice([None, "", "leave e 4471"])) for i in range(200)], "chunk_id bigint, text string, heading string")
    queries = spark.createDataFrame([(1, "leave policy"), (2, "error E-4471"), (3, "snake_case snake limit"), (4, "of the"), (5, ""), (6, "claims leave"), (7, "absent")], "query_id bigint, query string")
    plain = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 7)) for r in df.collect())
    kept = postings.prepared(chunks, queries)
    got = [plain(retrieval.bm25_search(chunks, queries, 9, kept=kept)), plain(retrieval.overlap(kept, queries, 9))]
    found = retrieval.bm25_search(chunks, queries, 9, kept=kept)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString() and found.columns == ["query_id", "chunk_id", "score", "rank"]
    monkeypatch.setattr(postings, "PLAIN", {})
    other = postings.prepared(chunks, queries)
    assert not other.whole and got == [plain(retrieval.bm25_search(chunks, queries, 9, kept=other)), plain(retrieval.overlap(other, queries, 9))]


def test_places_are_counted_before_questions_are_joined(spark):
    from tessera.operators.postings import prepared

    chunks = spark.createDataFrame([(1, "leaf e-4471 leaf", "leaf"), (2, "E 4471", None), (3, None, "4471 e")], "chunk_id bigint, text string, heading string")
    queries = spark.createDataFrame([(q, "leaf e-4471") for q in range(3)], "query_id int, query string")
    found = retrieval.phrase_hits(prepared(chunks, queries), queries)
    want = [("e-4471", 1, "text", 1), ("e-4471", 2, "text", 1), ("leaf", 1, "heading", 1), ("leaf", 1, "text", 2)]
    assert sorted(map(tuple, found.collect())) == [(q, *w) for q in range(3) for w in want]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(plan) if "Join" in x) < next(i for i, x in enumerate(plan) if "heading" in x)


def test_source_budget_passes_over_what_does_not_fit(spark):
    rows = [(1, 1, 11, "a", "A" * 200), (1, 2, 12, "b", "B" * 200), (1, 3, 13, "c", "C" * 20)]
    out = context.pack_sources(spark.createDataFrame(rows, "query_id bigint, rank int, chunk_id bigint, label string, text string"), 300).first()
    assert out.used == [11, 13] and out.context.startswith("[1] a\nAAA") and "[2] c" in out.context
    long = context.pack_sources(spark.createDataFrame([(1, 1, 11, "a", "A" * 2000)], "query_id bigint, rank int, chunk_id bigint, label string, text string"), 300).first()
    assert len(long.context) == len("[1] a\n") + 500


def test_history_keeps_the_last_four(spark):
    past = [{"role": "user", "content": str(i)} for i in range(10)]
    assert len(context.messages("q", "c", past)) == 6
    df = spark.createDataFrame([([("user", "a"), ("tool", "b"), ("user", "")],)], "h array<struct<role string, content string>>")
    assert df.select(F.size(context.history(F.col("h")))).first()[0] == 1


def test_scores(spark):
    found = spark.createDataFrame([(1, "x", 1), (2, "y", 4), (3, "z", None)], "query_id bigint, needle string, rank int")
    results = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id bigint, rank int")
    row = evaluate.scores(found, results).first()
    assert (round(row.hit_1, 3), round(row.hit_5, 3), round(row.mrr, 4), row.misses, row.returned) == (0.333, 0.667, 0.4167, 1, 1.0)


def test_answer_events(spark):
    from tessera.backends import Echo, ModelError, Scripted

    assert [e["type"] for e in context.answer_events("q", "ctx", [1], Echo())] == ["sources", "token", "done"]
    assert list(context.answer_events("q", "", [], Echo()))[-1]["text"] == context.NOTHING
    assert list(context.answer_events("q", "c", [1], Scripted(ModelError("down"))))[-1] == {"type": "error", "error": "down"}


def compound(n):
    return ", ".join(f"word{i} thing{i} matter{i}" for i in range(n))


def search_rows(spark, queries, **options):
    chunks = spark.createDataFrame([(i, i, f"word{i} thing{i} matter{i}", "", [1.0, float(i)]) for i in range(80)], "chunk_id bigint, doc_id bigint, text string, heading string, vec array<float>")
    documents = spark.createDataFrame([(i, f"d{i}") for i in range(80)], "doc_id bigint, title string")
    asked = spark.createDataFrame(queries, "query_id bigint, query string").withColumn("vec", F.array(F.lit(1.0), F.lit(0.5)))
    return retrieval.search(chunks, documents, asked, candidates=100, top_k=100, **options)


def test_clauses_of_one_question_are_never_those_of_another(spark):
    """A question with 70 clauses beside the next one, and ids as large as hashes."""
    embed = lambda df: df.withColumn("vec", F.array(F.lit(1.0), F.lit(0.5)))
    big = 2**62
    both = search_rows(spark, [(1, compound(70)), (2, "word79 thing79 matter79 word78 thing78 matter78 word77"), (big, compound(3)), (big + 1, compound(2))], expand=True, embed=embed)
    got = {(r.query_id, r.chunk_id, r.rank) for r in both.collect()}
    alone = set()
    for q, text in ((1, compound(70)), (2, "word79 thing79 matter79 word78 thing78 matter78 word77"), (big, compound(3)), (big + 1, compound(2))):
        alone |= {(r.query_id, r.chunk_id, r.rank) for r in search_rows(spark, [(q, text)], expand=True, embed=embed).collect()}
    assert got == alone and {c for q, c, _ in got if q == 1} >= set(range(70))


def test_clauses_are_reranked_only_when_asked_for(spark):
    question = "word1 thing1 matter1 and word2 thing2 matter2 nothing more"
    scores = lambda **o: {r.chunk_id: r.score for r in search_rows(spark, [(1, question)], reranker=retrieval.lexical_score, margin=0, **o).collect()}
    alone, expanded = scores(), scores(expand=True)
    assert alone[1] == round(20 * 3 / 8 - 10, 6) and expanded[1] == 10.0
