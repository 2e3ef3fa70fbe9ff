import json

from pyspark.sql import functions as F

from tessera.backends import ModelError, Scripted, has_model, parse_stream, setting, strip_thinking
from tessera.operators import context, turns
from tessera.streaming.turn_log import TURNS, Archive

ENTRY = "📅 Monday — 🌅 7:00 AM — *The Gate*\n\n" + "word " * 20 + "\n\n**What will you do?**\n\n" + "\n".join(f"{i}. Option {i}" for i in range(1, 6))


def test_parse_entry():
    out = turns.parse_entry(ENTRY, least=10, most=30)
    assert (out["title"], len(out["choices"]), out["words"], out["problems"]) == ("The Gate", 5, 20, [])
    assert turns.parse_entry("bare", least=1, most=5)["problems"] == ["0 options instead of 5"]
    assert turns.parse_entry("", least=1, most=5)["problems"] == ["0 options instead of 5", "0 words, at least 1 needed", "no narration"]
    messy = "Sure!\n📅 Tuesday, May 6th — 🌙 11:30 p.m. — **Night  Falls**\n\nIt was dark.\n1. leaked\n\n### What will you do?\n**1.** *Run   off*\n2) Hide\n3️⃣ 🗡 Fight\n3. again\n_4]_ Wait\n5: Sleep\n6. no"
    out = turns.parse_entry(messy, least=1, most=5)
    assert (out["title"], out["narration"], out["problems"]) == ("Night  Falls", "It was dark.", [])
    assert out["choices"] == ["Run off", "Hide", "🗡 Fight", "Wait", "Sleep"]
    bare = turns.parse_entry("He went on.\nAt 3. he stopped.\n1. Go\n2. Stay", least=1, most=9)  # no question: up to the first option
    assert (bare["title"], bare["narration"], bare["choices"]) == ("Continued", "He went on.\nAt 3. he stopped.", ["Go", "Stay"])


def test_extract_object():
    assert turns.extract_object('text ```json\n{"a": "}", "b": [1,],}\n``` more') == {"a": "}", "b": [1]}
    assert turns.extract_object("prose only") is None
    assert turns.extract_object("[1]") is None
    out = turns.distillate(json.dumps({"summary": "S  x", "facts": "a long fact", "present": ["Reina", "!"], "minutes_elapsed": True, "relationships": [{"other": "Bo B", "closeness": 99}]}))
    assert (out["summary"], out["facts"], out["present"], out["minutes"], out["relationships"][0]["closeness"]) == ("S x", ["a long fact"], ["reina"], 10, 10)
    assert turns.distillate("nothing")["error"]


def test_repair():
    block = "What will you do?\n" + "\n".join(f"{i}) go {i}" for i in range(1, 6))
    entry, notes = turns.repair(Scripted(block), [], "word " * 20, least=10, most=30)
    assert len(entry["choices"]) == 5 and entry["problems"] == [] and notes == ["0 options, 20 words became 5, 20"]
    entry, notes = turns.repair(Scripted("no help"), [], "word " * 20, least=10, most=30, repairs=0)
    assert notes == ["kept as written: 0 options instead of 5"]
    entry, notes = turns.repair(Scripted(ModelError("gone")), [], "<think>x</think>" + "word " * 20, least=10, most=30)  # a model that fails loses nothing
    assert entry["narration"] == ("word " * 20).strip() and notes == ["the repair failed: gone", "kept as written: 0 options instead of 5"]
    entry, notes = turns.repair(Scripted("too short"), [], ENTRY, least=30, most=60)
    assert (entry["title"], len(entry["choices"]), notes[0]) == ("The Gate", 5, "a revision lost the options and was not taken")
    entry, notes = turns.repair(Scripted(ENTRY.replace("word " * 20, "word " * 40)), [], ENTRY, least=30, most=60)
    assert entry["words"] == 40 and entry["problems"] == []


def test_model_stream():
    lines = [b"", b"junk", b'{"message":{"content":"a"}}', b'{"message":{"content":"b"},"done":true}', b'{"message":{"content":"c"}}']
    assert "".join(parse_stream(lines)) == "ab"
    assert has_model(["x:latest"], "x") and not has_model(["xy"], "x")
    assert strip_thinking("<think>hmm</think>The answer is 4.") == "The answer is 4."


def test_settings(monkeypatch):
    monkeypatch.setenv("TESSERA_X", "yes")
    assert setting("TESSERA_X", False) is True and setting("TESSERA_X", False, given=False) is False
    monkeypatch.setenv("TESSERA_X", "")
    assert setting("TESSERA_X", 4) == 4


def row(n, **more):
    base = {"campaign": "c", "n": n, "minutes": 25, "location": f"place {n}", "summary": f"summary of turn {n}", "facts": [f"a fact from turn {n}"], "events": [], "when": "Day 1"}
    return tuple((base | more)[c.split()[0]] for c in TURNS.split(", "))


def test_archive_is_idempotent_and_late_turns_do_not_move_state(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/archive")
    archive.write(spark.createDataFrame([row(1), row(3)], TURNS), 0)
    archive.write(spark.createDataFrame([row(2), row(3)], TURNS), 1)
    archive.write(spark.createDataFrame([row(2), row(3)], TURNS), 1)  # a batch that runs again
    assert archive.memories().count() == 6
    state = archive.state().first()
    assert (state.turn, state.minutes, state.location) == (3, 75, "place 3")


def test_stream(spark, tmp_path):
    source = tmp_path / "log"
    spark.createDataFrame([row(1), row(2)], TURNS).write.json(str(source))
    archive = Archive(spark, f"file://{tmp_path}/archive")
    stream = lambda: spark.readStream.schema(TURNS).json(str(source))
    archive.run(stream(), f"{tmp_path}/checkpoint")
    archive.run(stream(), f"{tmp_path}/checkpoint")
    assert archive.memories().count() == 4
    spark.createDataFrame([row(3)], TURNS).write.mode("append").json(str(source))
    archive.run(stream(), f"{tmp_path}/checkpoint")
    assert archive.memories().count() == 6 and archive.state().first().turn == 3


def test_an_empty_cast_clears_the_stage(spark):
    cast = spark.createDataFrame([("a", True), ("b", False)], "slug string, present boolean")
    none = spark.createDataFrame([], "slug string")
    assert [r.present for r in turns.set_present(cast, none).collect()] == [False, False]
    assert {r.slug: r.present for r in turns.set_present(cast, spark.createDataFrame([("b",), ("zz",)], "slug string")).collect()} == {"a": False, "b": True}


def test_folds_that_fail_leave_their_range_open(spark):
    log = [("a", n, f"s{n}", n not in (2, 3, 7)) for n in range(1, 9)] + [("b", 1, "x", True), (None, 5, None, True), (None, 5, "y", True), (None, 6, "z", None), ("c", None, "w", True)]
    rows = spark.createDataFrame(log, "who string, n int, summary string, folded boolean")
    got = sorted(map(tuple, turns.folds(rows, ["who"], every=2).collect()), key=str)
    assert got == [("a", 1, 4, "1. s1\n2. s2\n3. s3\n4. s4"), ("a", 5, 6, "1. s5\n2. s6"), ("a", 7, 8, "1. s7\n2. s8"), (None, 1, 5, "1. \n2. y")]
    assert turns.folds(rows.limit(0), ["who"]).count() == 0
    long = spark.range(1, 30_001).select(F.lit("a").alias("who"), F.col("id").alias("n"), F.lit("s").alias("summary"), (F.col("id") % 7 == 0).alias("folded"))
    assert turns.folds(long.unionByName(long.withColumn("who", F.lit("b"))), ["who"], every=3).where("to_turn - from_turn = 6").count() == 2 * (30_000 // 7)


def test_a_reset_ends_what_a_chat_remembers(spark):
    log = [(1, "user", "one"), (2, "assistant", "two"), (3, "user", " CLEAR\n"), (4, "user", "three"), (5, "assistant", "reset"), (6, "user", "four"), (7, None, None), (8, "user", "five")]
    rows = spark.createDataFrame([("c", *r) for r in log], "chat string, n int, role string, content string")
    got = {r.n: [m.content for m in r.memory] for r in context.session_memory(rows, ["chat"], until_reset=True).collect()}
    assert got == {2: ["one"], 5: ["three"], 6: ["three", "reset"], 7: ["three", "reset", "four"], 8: ["three", "reset", "four"]}
    assert {r.n for r in context.session_memory(rows, ["chat"]).collect()} == set(range(2, 9))
