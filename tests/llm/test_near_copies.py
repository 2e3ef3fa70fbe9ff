"""The near-copy stage against planted copies whose similarity is known."""

import random

import corpus_pipeline
import numpy as np

from tessera.llm import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) / len(a | b)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def edited(rnd, text, least):
    """Words replaced one by one while the similarity stays at ``least`` or more; that text, and the first one below."""
    words = text.split()
    while True:
        before = " ".join(words)
        words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10**9)}"
        if similarity(text, " ".join(words)) < least:
            return before, " ".join(words)


def test_copies_just_above_the_similarity_go_and_others_stay(spark):
    rnd = random.Random(4)
    texts, gone = [], set()
    for _ in range(60):
        base = " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(100, 500)))
        for least in (0.8, 0.9):
            texts += [base.replace("w", f"x{len(texts)}w"), ""]
            texts[-1] = edited(rnd, texts[-2], least)[0]
            gone.add(len(texts) - 1)
        texts += [base, edited(rnd, base, 0.8)[1]]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, texts), "")
    assert {r.doc_id for r in out.collect()} == set(range(len(texts))) - gone
    assert tuple(out.columns) == corpus_pipeline.COLUMNS


def test_large_groups_are_dealt_out_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    rnd = random.Random(5)
    texts = [" ".join(f"w{i}" for i in range(200))]
    for _ in range(40):
        words = texts[-1].split()
        words[rnd.randrange(200)] = f"edit{rnd.randrange(10**9)}"
        texts.append(" ".join(words))
    assert similarity(texts[0], texts[-1]) < 0.5
    texts += [None, "", " \n", "one two", "ONE  two", "one", texts[0]]
    out = {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts)).collect()}
    assert out == {i: 0 for i in range(41)} | {41: 41, 42: 41, 43: 41, 44: 44, 45: 44, 46: 46, 47: 0}
    assert near_copies.near_copies(frame(spark, texts).limit(0)).count() == 0


def test_pairs_are_those_of_a_plain_comparison():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.choice(60, size=rnd.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    want = {(a, b) for b in range(80) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    sets += [sets[0], sets[1]]
    want |= {(a, 80 + b) for b in (0, 1) for a in range(80) if a == b or (min(a, b), max(a, b)) in want} | ({(80, 81)} if (0, 1) in want else set())
    inner = set(zip(*(x.tolist() for x in near_copies.similar(sets, None)), strict=True))
    across = set(zip(*(x.tolist() for x in near_copies.similar(sets[:40], sets[40:])), strict=True))
    assert inner == want and across == {(a, b) for a, b in want if a < 40 <= b}
