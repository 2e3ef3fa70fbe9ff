"""Every query of the catalogue against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import catalogue, state_catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if v is None or str(v) in ("NaT", "<NA>") else str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_duckdb(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_relationships_round_halves_as_the_sql_does(spark, tmp_path):
    c = duckdb.connect()
    path = f"{tmp_path}/customer.parquet"
    c.execute(f"copy (select i::BIGINT c_custkey, 'C' || i c_name, 10 c_nationkey, 250.0::DOUBLE * i c_acctbal, 'M' c_mktsegment from range(30) r(i)) to '{path}'")
    c.execute(f"create view customer as select * from '{path}'")
    got = catalogue.QUERIES["upsert_relationships"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.execute(catalogue.ORACLES["upsert_relationships"]).df())


@pytest.fixture(scope="module")
def compound(tmp_path_factory):
    """A compound question whose clauses each have a text of their own, and the vectors of these."""
    folder, c = tmp_path_factory.mktemp("compound"), duckdb.connect()
    question = "red stones under water, blue birds over mountains and green fish below bridges"
    texts = ["red stones under water", "blue birds over mountains", "green fish below bridges", "water", "nothing at all"]
    c.execute("create table documents as select * from (values " + ", ".join(f"({i}::BIGINT, '{t}', 'en', 's{i}')" for i, t in enumerate(texts)) + ") v(doc_id, text, lang, source)")
    c.execute("create table benchmark as select 1::BIGINT item_id, ? as text", [question])
    c.execute("create table embeddings as select i::BIGINT vec_id, [1.0::FLOAT, i::FLOAT] embedding, 1 as label from range(5) r(i)")
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"copy {t} to '{folder}/{t}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["rerank", "retrieval_modes"])
def test_reranking_keeps_the_best_of_question_and_clauses(spark, compound, name):
    folder, c = compound
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    assert rows(got) == rows(c.execute(catalogue.ORACLES[name]).df())
    if name == "rerank":  # a text that answers one clause in full scores as if it answered the question
        assert {r.chunk_id: r.score for r in got.itertuples()}.items() >= {0: 10.0, 1: 10.0, 2: 10.0}.items()
    else:  # and others lie beyond the margin
        assert got.set_index("mode").returned["hybrid+rerank"] == 3


@pytest.mark.parametrize("name", ["document_cap", "retrieval_scores", "expanded_rerank"])
def test_ranked_chunks_go_to_the_texts(spark, name):
    """Whatever the size of the tables: documents are joined with the ranked chunks where they are read, and texts with no vectors."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    column = "source:string" if name == "document_cap" else "text:string"
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "documents.parquet" in line and column in line.split("ReadSchema")[1]]
    assert scans
    for i in scans:
        above, at = [], depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                above.append(plan[j])
        first = next(line for line in above if "Join" in line or "Exchange" in line)
        assert "BroadcastHashJoin" in first, first
