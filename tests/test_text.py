from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as T
from tessera.functions.porter import stem, tokens_of


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_query_terms(spark):
    terms = one(spark, T.query_terms(F.col("q")), q="What does the error E-4471 mean?")
    assert "e-4471" in terms and "the" not in terms
    assert one(spark, T.query_terms(F.col("q")), q="???") == []
    assert one(spark, T.query_terms(F.col("q")), q="what is the") == ["what", "is", "the"]


def test_clauses(spark):
    c = lambda q: one(spark, T.clauses(F.col("q")), q=q)
    assert c("how much holiday do I get") == []
    assert c("what is the per diem rate and the hotel cap in London?") == ["what is the per diem rate", "the hotel cap in London"]
    assert c("is the policy black and white on this question") == ["is the policy black", "white on this question"]


def test_trail_and_citation(spark):
    assert one(spark, T.trail(F.col("t"), F.col("h")), t="Handbook 2026", h="Handbook 2026 > Leave") == "Handbook 2026 > Leave"
    label = T.citation(F.col("p"), F.col("t"), F.col("n"), F.col("h"))
    assert one(spark, label, p="/a/handbook.pdf", t="x", n=14, h="Leave") == "handbook.pdf p.14 — Leave"
    assert one(spark, label, p="memory://event/00001/00", t="Turn 1", n=0, h="Monday, April 14th, 2025 > event") == "Turn 1 — Monday, April 14th, 2025 > event"


def test_thinking_and_titles(spark):
    assert one(spark, T.strip_thinking(F.col("s")), s="<think>hmm</think>The answer is 4.") == "The answer is 4."
    assert one(spark, T.strip_thinking(F.col("s")), s=" <think>never closed") == ""
    assert one(spark, T.title(F.col("s"), F.lit("my_file-name")), s="# Employee Handbook\nx") == "Employee Handbook"
    assert one(spark, T.title(F.col("s"), F.lit("my_file-name")), s="tiny") == "my file name"


def test_clock(spark):
    ts = D.parse(F.lit("2025-04-14"), F.lit("15:35"))
    assert one(spark, D.pretty_date(ts)) == "Monday, April 14th, 2025"
    assert one(spark, D.pretty_time(ts)) == "3:35 PM"
    assert one(spark, D.pretty_time(D.advance(ts, F.lit(25)))) == "4:00 PM"
    assert one(spark, D.pretty_date(D.jump_to(ts, F.lit("2025-04-22"), F.lit("bad")))) == "Tuesday, April 22nd, 2025"
    assert one(spark, D.header(ts, F.lit(" Arrival "))) == "📅 Monday, April 14th, 2025 — 🕛 3:35 PM — Arrival"
    assert one(spark, D.clamp_minutes(F.lit("x"))) == 10


def test_choices(spark):
    assert len(one(spark, D.ensure_five(F.array(F.lit("a"))))) == 5
    pending = F.array(*[F.lit(c) for c in "abcde"])
    assert one(spark, D.resolve_input(F.lit(" 4 "), pending)) == "d"
    assert one(spark, D.resolve_input(F.lit("2️⃣ go"), pending)) == "b"
    assert one(spark, D.resolve_input(F.lit("9"), pending)) == "9"


def test_porter():
    want = {"leave": "leav", "leaving": "leav", "policies": "polici", "carry": "carri", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "sky": "sky"}
    assert {w: stem(w) for w in want} == want
    assert tokens_of("Été carry-over") == ["et", "carri", "over"]


def test_porter_against_sqlite():
    import sqlite3

    import pyarrow.parquet as pq

    words = sorted({w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() for w in t.lower().split() if w.isascii() and w.isalpha()})[:8000]
    words += "generalizations oscillators conditional rationalization triplicate electriciti hopefulness goodness adjustable replacement irritant communism controlling filing failing fizzed".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words, 1)))
    stems = dict(db.execute("select doc, term from v").fetchall())
    wrong = [(w, stem(w), stems[i]) for i, w in enumerate(words, 1) if stem(w) != stems[i]]
    assert len(wrong) == 0, wrong[:10]


def test_one_folding_for_index_and_stemmer(spark):
    """The native rule and the stemmer's give the same tokens for every letter that both may see, composed or not."""
    import re
    import unicodedata

    from tessera.functions.porter import unaccented

    letters = [chr(c) for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)) if unicodedata.category(chr(c)) in ("Lu", "Ll") and len(chr(c).lower()) == 1]
    texts = [f"a{x}b" for x in letters] + [unicodedata.normalize("NFD", f"{x}z") for x in letters] + ["Đường ŁÓDŹ şehir čeština naïve", None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.index_tokens(F.col("t")).alias("x")).collect()
    wrong = [(texts[r.i], r.x) for r in got if (r.x or []) != re.findall(r"[^\W_]+", unaccented(texts[r.i]))]
    assert not wrong, wrong[:20]


def test_rounded_is_what_the_sql_gives(spark):
    import duckdb

    values = [-1e-9, 4.99999e-7, 5e-7, -5e-7, 0.0, -0.0, 1.0000005, -2.5000015, 0.1234565, float("nan"), 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(T.rounded(F.col("v"), 6)).collect()]
    want = [duckdb.execute("select round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))  # -0.0 is not 0.0


def test_tokens_of_a_python_pass_are_the_index_tokens(spark):
    texts = ["", None, "Plain ASCII, e-4471 snake_case\x00x\x1fy", "Été naïve ÜBER straße", "ά Ω ж Й ё", "e\u0301 a\u0300b", "一二 ٣٤ Ⅷ ½ x² 𝔸𝟙", "a\xa0b\u2003c„d“ ’s"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] or [] for r in df.select(T.index_tokens(F.col("t"))).collect()] == [T.tokens_of(t) for t in texts]
    from tessera.functions.porter import stemmed_tokens, stemmed_tokens_of

    assert [list(r[0]) for r in df.select(stemmed_tokens(F.col("t"))).collect()] == [stemmed_tokens_of(t) for t in texts]


def test_folding_a_text_looks_up_each_distinct_letter_once(monkeypatch):
    class Seen(dict):
        def __getitem__(self, c):
            asked.append(c)
            return super().__getitem__(c)

    asked: list[str] = []
    monkeypatch.setattr(T, "_FOLD", Seen(T._FOLD))
    assert T.tokens_of("éé È ΅pc €é_ж") == ["ee", "e", "pc", "e", "ж"]
    assert sorted(asked) == sorted("éè΅")


def test_stemming_a_text_does_not_walk_through_the_stems_of_others(monkeypatch):
    from tessera.functions import porter

    class Stems(type(porter._STEMS)):
        def keys(self):
            raise AssertionError("all remembered stems are walked through")

        __iter__ = items = keys

    monkeypatch.setattr(porter, "_STEMS", Stems(leaves="leav"))
    assert porter.stemmed_tokens_of("Leaves running, leaves claims") == ["leav", "run", "leav", "claim"]
