from collections import Counter

import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import format_automata, mixing, near_copies, packing, rule_ensemble

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out[name] = docs
    return out


def test_stages(spark, steps):
    docs = steps["documents"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert tuple(steps[name].columns) == corpus_pipeline.COLUMNS
    # quality: what the model scores below the threshold goes, and nothing else
    model = rule_ensemble.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in rule_ensemble.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in steps["quality"].collect()} == good
    # near duplicates: one for each component
    parts = near_copies.near_copies(steps["quality"])
    assert sorted(r.doc_id for r in steps["near_duplicates"].collect()) == sorted(r[0] for r in parts.select("component_id").distinct().collect())
    # secrets: the same documents; no fixed pattern is left; texts without secrets are as they were
    before = {r.doc_id: r.text for r in steps["near_duplicates"].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in steps["secrets"].collect()}
    assert before.keys() == after.keys()
    for i, (text, n) in after.items():
        assert n == len(text) and not format_automata.base_spans(text)
        assert text == before[i] or "[secret]" in text
    # mixing: each row as often as the fit of its own input says
    rows = steps["secrets"].collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mixing.train(steps["secrets"], labels)
    found = mixing.fit(mixing.membership(steps["secrets"], model, text="text"), upsample=False, keep_clean=True)
    n = mixing.copies(model.of([r.text for r in rows]), found, [r.doc_id for r in rows], [r.text for r in rows])
    want = Counter({r.doc_id: int(k) for r, k in zip(rows, n, strict=True) if k})
    assert Counter(r.doc_id for r in steps["mixing"].collect()) == want
    # packing: every id of every remaining document once for each time it is there
    tokens = packing.pack(steps["mixing"]).agg(F.sum("length")).first()[0]
    assert steps["packing"].agg(F.sum("length")).first()[0] == tokens


def test_registered_queries(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert __spark_entry__.entry(spark).count() > 0
    for name in (n for n in names if n.startswith("op")):
        table = "pages" if name.startswith(("op1_", "op6_")) else "documents"
        assert names[name](spark, SF).count() >= spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_run(spark, steps):
    key = lambda rows: Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(steps["packing"].collect())


def odd_rows():
    texts = [None, "", " \n ", "plain words of a text " * 9, "plain words of a text " * 9, "### $$$ ||| " * 20, "token = abcdefghijkl1234 and more words here", "w" * 3000]
    return [(i if i % 5 else None, t, "en", "s", len(t or ""), "id", "fp", "label", "part") for i, t in enumerate(texts * 3)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, tmp_path, name):
    """Null ids and texts, empty texts, repeated rows, clashing columns; empty tables; tables without labels."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, label string, part string"
    docs = spark.createDataFrame(odd_rows(), schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)[name]
    for marks in ([(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None)], []):
        folder = f"file://{tmp_path}/{len(marks)}"
        spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "packing":
            assert {r.doc_id for r in rows} == {r[0] for r in odd_rows()}
            continue
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        left = Counter((r.doc_id, r.text) for r in rows)
        there = Counter((r[0], r[1]) for r in odd_rows())
        if name == "secrets":
            assert sum(left.values()) == len(odd_rows()) and sum(t is None for _, t in left.elements()) == 3 and not any("abcdefghijkl1234" in (t or "") for _, t in left)
        elif name == "near_duplicates":
            assert all(k in there for k in left) and max(left.values()) == 1
            assert {t for _, t in left} >= {"w" * 3000, "### $$$ ||| " * 20}  # texts unlike all others stay
        else:
            assert all(k in there for k in left) and (name == "mixing" or all(n == there[k] for k, n in left.items()))  # rows that are alike fare alike
