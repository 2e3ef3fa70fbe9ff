"""Licence scans against a plain version in Python, planted notices, and edges."""

import math
import re

import pytest

from tessera.llm import licence_index
from tessera.llm.licence_index import BASE, RAREST, SHARE, SLACK, TEMPLATES, Licences

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, w string, hits string, row int, labels string"
FILLER = "Quiet rivers carry small boats past the old mill while several people read this and talk of other work .".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "id", "w", "h", 1, "l") for i, t in rows], SCHEMA)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def standing(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def plain(rows):
    """Every template at every window of every text."""
    known = {w for t in TEMPLATES for w in t.words if len(w) >= 5}
    texts = [(i, words_of(t)) for i, t in rows]
    weight = {w: round(1e6 * math.log(1 + len(texts) / (sum(w in x for _, x in texts) + 1))) for w in known}
    out = []
    for i, words in texts:
        places = [(p, label) for phrase, label in BASE.items() for p in standing(words, phrase)]
        labels, score = {x for _, x in places}, 0.0
        for t in TEMPLATES:
            rare = sorted({w for w in t.words if w in known}, key=lambda w: (-weight[w], w))[:RAREST]
            whole = sum(weight[w] for w in rare)
            for window in range(-len(t.words) // SLACK - 2, len(words) // SLACK + 1):
                begin = lambda p, q, at=window * SLACK: at <= p - q < at + 2 * SLACK
                own = {w for w in rare if any(begin(p, q) for p, x in enumerate(words) if x == w for q, y in enumerate(t.words) if y == w)}
                share = sum(weight[w] for w in own) / whole
                score = max(score, share)
                if share >= SHARE and all(any(begin(p, t.place(k)) for p in standing(words, k)) for k in t.phrases):
                    labels.add(t.label)
        at = [p for p, _ in places]
        out.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9)))
    return out


def told(df):
    return [(*r[:7], round(r["score"], 9)) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def notices():
    rows = [(k, " ".join([*FILLER[: k % 7], t.text, *FILLER])) for k, t in enumerate(TEMPLATES)]
    mit = next(t for t in TEMPLATES if t.label == "mit").text
    half = mit.split()[:20]
    rows += [
        (20, mit.replace("free of charge to", "free of charge and gladly to").title()),  # a few words more
        (21, mit.replace("permission is hereby granted", "permission is granted")),  # a key phrase is not there
        (22, " ".join(half)), (23, " ".join(reversed(mit.split()))), (24, " ".join(w for x in mit.split() for w in (x, *FILLER))),
        (25, "Released under the MIT License. (c) CC-BY 4.0, cc by; the Apache License"), (26, "GNU General Public\nLicense gnu general public license"),
        (27, None), (28, ""), (29, " \n--"), (30, "mit"), (31, "Été licenſe MIT LICENSEé mit license"), (31, "again mit license"), (None, "Apache License"), (32, mit), (32, mit),
        (33, " ".join(FILLER * 300) + " " + mit + " " + TEMPLATES[0].text), (34, "cc\x00by gnu_general public license \U0001f600"),
    ]
    return rows


def test_against_every_template_at_every_place(spark):
    rows = notices() + [(100 + i, " ".join(FILLER)) for i in range(40)]
    got, want = order(told(Licences().scan(frame(spark, rows).repartition(3)))), order(plain(rows))
    assert got == want
    labels = {r[0]: r[6] for r in want}
    assert all(t.label in labels[k].split(",") for k, t in enumerate(TEMPLATES)), labels
    assert labels[20] == "mit" and labels[21] == labels[22] == labels[23] == labels[24] == "" and labels[33] == "agpl,mit"
    assert all(labels[100 + i] == "" for i in range(40))


def test_key_phrases_tell_like_notices_apart(spark):
    labels = {r["doc_id"]: r["labels"] for r in Licences().scan(frame(spark, [(k, t.text) for k, t in enumerate(TEMPLATES)])).collect()}
    assert {t.label: labels[k] for k, t in enumerate(TEMPLATES) if t.label in ("agpl", "gpl", "lgpl")} == {"agpl": "agpl", "gpl": "gpl", "lgpl": "lgpl"}


def test_a_notice_in_every_file_is_still_found(spark):
    rows = [(i, TEMPLATES[2].text + " " + " ".join(FILLER)) for i in range(50)]
    assert {(r["labels"], r["score"]) for r in Licences().scan(frame(spark, rows)).collect()} == {("bsd", 1.0)}


def test_empty_table_and_own_templates(spark):
    assert Licences().scan(frame(spark, [])).collect() == []
    own = Licences((licence_index.Template("own", "nobody except squirrels shall gather walnuts", ("squirrels shall gather",)),), {"house rules": "house"})
    got = {r["doc_id"]: r["labels"] for r in own.scan(frame(spark, [(1, "Nobody, except squirrels, shall gather walnuts!"), (2, "house rules"), (3, "walnuts")])).collect()}
    assert got == {1: "own", 2: "house", 3: ""}


def test_no_python_in_the_plan(spark):
    df = Licences().scan(frame(spark, notices()))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("t", TEMPLATES, ids=lambda t: t.label)
def test_templates_hold_their_phrases(t):
    assert all(standing(t.words, p) for p in t.phrases) and words_of(t.text) == t.words
