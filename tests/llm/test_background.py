"""The background that candidates for secrets are scored against covers every text."""

import zlib

from tessera.llm import format_automata


def test_every_text_counts_in_the_background(spark):
    texts = [f"number {i} drqxvzk wordstoread" for i in range(300)]
    texts = [t for t in texts if zlib.crc32(t.encode()) % 64][:200] + ["a rare jkjkjkjk source"]
    assert all(zlib.crc32(t.encode()) % 64 for t in texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    detector = format_automata.train(docs)
    runs = [r for t in texts for r in set(format_automata.ORDINARY.findall(t))]
    assert sum(format_automata.letter_pairs(runs).values()) < format_automata.PAIRS
    assert detector.pairs == dict(format_automata.letter_pairs(runs)) and detector.pairs["jk"] == 4
    assert format_automata.train(docs.repartition(5)).pairs == detector.pairs


def test_all_distinct_runs_count_and_a_larger_corpus_scores_alike(spark):
    letters = "abcdefghijklmnop"
    texts = ["word" + "".join(letters[int(c, 16)] for c in f"{i:05x}") for i in range(6000)]
    docs = spark.createDataFrame([(" ".join(texts[k : k + 100]),) for k in range(0, 6000, 100)], "text string")
    detector = format_automata.train(docs)
    share = detector.pairs["^w"] / sum(detector.pairs.values())
    assert abs(share - 1 / 9) < 1e-9 and abs(sum(detector.pairs.values()) - format_automata.PAIRS) < 1e-6
    twice = format_automata.train(docs.union(docs))
    assert all(abs(twice.pairs[p] - n) < 1e-6 for p, n in detector.pairs.items())
