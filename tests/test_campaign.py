import json
import threading
import urllib.error
import urllib.request

import pytest

from tessera.backends import ModelError, Scripted
from tessera.operators import campaign as C

SEED = {
    "title": "The Gate", "clock": {"date": "2025-04-14", "time": "15:35", "location": "harbour"},
    "characters": [{"slug": "reina", "name": "Reina", "role": "pilot", "present": True, "protagonist": True}, {"slug": "bo", "name": "Bo", "present": True}, {"slug": "ada", "name": "Ada"}],
    "relationships": [{"other": "bo", "label": "friend", "closeness": 7}], "flags": {"door": "shut"}, "lore": ["The harbour gate has been shut for a century."],
}
ENTRY = "📅 x — 🌅 7:00 AM — Dawn\n\n" + "word " * 20 + "\n\n**What will you do?**\n\n" + "\n".join(f"{i}. Option {i}" for i in range(1, 6))
NOTE = json.dumps({"summary": "Reina walked along the quay.", "facts": ["The quay is wet tonight"], "events": ["A bell rang twice"], "present": ["reina", "ghost"], "flags": {"door": "open"},
                   "relationships": [{"other": "bo", "closeness": 99}, {"other": "ghost", "closeness": 1}], "minutes_elapsed": 25, "location": "quay"})


@pytest.fixture
def made(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps(SEED))
    c = C.Campaign(spark, f"file://{tmp_path}/campaigns/gate", Scripted(ENTRY, NOTE, ENTRY, NOTE), least=10, most=30, arc_every=3)
    assert c.seed(f"file://{tmp_path}/seed.json") == {"characters": 3, "relationships": 1, "flags": 1, "lore": 1}
    return c


def test_two_turns(spark, made, tmp_path):
    assert C.campaigns(spark, f"file://{tmp_path}/campaigns") == ["gate"] and made.started
    events = list(made.play("look at the gate"))
    assert [e["type"] for e in events] == ["recall", "token", "entry", "archiving", "turn"]
    status = made.status()
    assert (status["clock"], status["location"], status["present"]) == ("2025-04-14 16:00:00", "quay", ["reina"])
    assert status["memories"] == {"lore": 1, "summary": 1, "fact": 1, "event": 1}
    assert made.tables.read("relationships").first().closeness == 10 and made.tables.read("relationships").count() == 1
    assert json.loads(made.tables.read("flags").first().value) == "open"
    list(made.play("2"))
    turn = made.tables.read("turns").where("n = 2").first()
    assert turn.action == "Option 2" and str(turn.at) == "2025-04-14 16:00:00" and len(made.history(1)) == 1
    assert "Place: quay" in made.prompt("go", []) and "Reina — pilot" in made.prompt("go", [])


def test_failures(spark, made):
    made.model = Scripted(ModelError("down"))
    assert [e["type"] for e in made.play("look")] == ["recall", "error"] and made.turn_count() == 0
    assert list(made.play("  "))[-1]["type"] == "error"
    made.model = Scripted(ENTRY, ModelError("down"))
    assert list(made.play("look"))[-1]["error"] == "down"
    assert made.tables.read("turns").first().summary == "(turn 1) look"


def test_late_archive_moves_memory_but_not_state(spark, made):
    made.model = Scripted(NOTE)
    made._append({"title": "a", "narration": "n", "choices": [], "words": 1}, "first")
    made._append({"title": "b", "narration": "n", "choices": [], "words": 1}, "second")
    made._archive(2)
    clock = made.clock()
    assert made.catch_up() == [1] and made.clock() == clock and made.catch_up() == []
    assert made.status()["memories"]["fact"] == 2


def test_server(spark, tmp_path):
    from tessera.operators.index import Index
    from tessera.server import serve

    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.md").write_text("# Runbook\n## Error E-4471\nRestart the broker.\n")
    ix = Index(spark, f"file://{tmp_path}/index")
    server = serve(ix, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    post = lambda p, v: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{p}", json.dumps(v).encode())).read().decode()
    assert json.loads(post("/api/ingest", {"paths": [str(tmp_path / "corpus")]}))["added"] == 1
    assert json.loads(post("/api/search", {"question": "E-4471"}))["hits"][0]["label"] == "a.md — Error E-4471"
    found = json.loads(post("/api/search", {"question": "E-4471"}))
    assert found["counts"]["returned"] == 1 and found["counts"]["bm25"] == 1 and {"search_ms", "dense_ms", "bm25_ms"} <= found["timings"].keys()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}").read().decode()
    assert json.loads(get("/api/stats"))["by_ext"] == {".md": 1} and "<form" in get("/")
    kinds = [json.loads(x[6:])["type"] for x in post("/api/ask", {"question": "E-4471"}).split("\n\n") if x]
    assert kinds == ["sources", "token", "done"]
    server.shutdown()


def test_game_server_and_commands(spark, made, tmp_path, capsys, monkeypatch):
    from tessera import play
    from tessera.server import serve_game

    server = serve_game(made, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    get = lambda p: urllib.request.urlopen(at + p).read().decode()
    post = lambda p, v: urllib.request.urlopen(urllib.request.Request(at + p, json.dumps(v).encode())).read().decode()
    assert "<form" in get("/") and json.loads(get("/api/state"))["unarchived"] == 0
    events = [json.loads(x[6:]) for x in post("/api/turn", {"action": "look"}).split("\n\n") if x]
    assert [e["type"] for e in events] == ["recall", "token", "entry", "archiving", "done"]
    state = json.loads(get("/api/state"))
    assert state["turns"] == 1 and len(state["choices"]) == 5 and "Dawn" in state["last_entry"] and state["relationships"][0]["name"] == "Bo"
    assert [t["n"] for t in json.loads(get("/api/history?limit=3"))["turns"]] == [1]
    assert "quay" in json.loads(post("/api/recall", {"query": "walked along the quay"}))["memories"][0]["text"]
    with pytest.raises(urllib.error.HTTPError):
        post("/api/recall", {})
    server.shutdown()

    root = ["--root", f"file://{tmp_path}/campaigns", "--llm", "echo"]
    monkeypatch.setattr(play, "session", lambda: spark)
    assert play.main([*root, "list"]) == 0 and capsys.readouterr().out.strip() == "gate"
    assert play.main([*root, "status", "nowhere"]) == 1 and play.main([*root, "new", "gate", "--seed", "x"]) == 1
    (tmp_path / "opening.txt").write_text("It began with a long walk along the river to the old mill.")
    assert play.main([*root, "new", "mill", "--seed", f"file://{tmp_path}/seed.json", "--opening", f"file://{tmp_path}/opening.txt", "--title", "The Mill"]) == 0
    assert play.main([*root, "turn", "mill", "go", "on"]) == 0 and play.main([*root, "play", "mill"], lines=["2\n", "exit\n", "never\n"]) == 0
    capsys.readouterr()
    assert play.main([*root, "history", "mill"]) == 0
    assert capsys.readouterr().out.startswith("1. The Mill (13 words)")
    (tmp_path / "notes.md").write_text("# World\n\nThe mill stands on the north bank and belongs to nobody.\n")
    assert play.main([*root, "lore", "mill", f"{tmp_path}/notes.md"]) == 0 and play.main([*root, "lore", "mill", "/nowhere"]) == 1
    assert play.main([*root, "recall", "mill", "who", "owns", "the", "mill"]) == 0
    assert "belongs to nobody" in capsys.readouterr().out


def test_lore_from_files_is_taken_in_once(spark, made, tmp_path):
    (tmp_path / "lore").mkdir()
    (tmp_path / "lore" / "a.md").write_text("# World\n## North\nIt always snows in the north.\n")
    (tmp_path / "lore" / "b.bin").write_bytes(b"x")
    (tmp_path / "lore" / "c.pdf").write_bytes(b"no pdf")
    assert made.ingest_lore([f"{tmp_path}/lore"]) == {"added": 1, "failed": 1, "skipped": 1, "missing": []}
    assert made.ingest_lore([f"{tmp_path}/lore", "/nowhere"]) == {"added": 0, "failed": 1, "skipped": 1, "missing": ["/nowhere"]}
    row = made.tables.read("memories").where("text LIKE '%snows%'").first()
    assert (row.kind, row.heading) == ("lore", "World > North > lore") and made.status()["memories"]["lore"] == 2


def test_a_title_that_is_missing_comes_from_the_archive(spark, made):
    made.model = Scripted(json.dumps(json.loads(NOTE) | {"title": "The Wet Quay"}))
    n = made._append({"title": "", "narration": "n", "choices": [], "words": 1}, "x")
    made._archive(n)
    assert made.history(1)[0]["title"] == "The Wet Quay"


def test_pointer_never_goes_missing(spark, tmp_path):
    from tessera.operators.pointer import Pointer

    p = Pointer(spark, f"file://{tmp_path}/p", "meta")
    assert p.read() is None
    for i in range(6):
        p.write({"i": i})
        assert p.read() == {"i": i}
    assert len([f for f in (tmp_path / "p").iterdir() if f.name.startswith("meta-")]) == 3
    p.fs.create(p._file(".meta-crashed"), True).close()  # a crash before the rename leaves the last version
    assert p.read() == {"i": 5}
    first, second = Pointer(spark, p.root, "meta"), Pointer(spark, p.root, "meta")
    second.versions = lambda found=first.versions(): found  # both have seen the same version
    first.write({"i": 6})
    with pytest.raises(OSError):
        second.write({"i": 7})


def test_tables_keep_one_generation_before(spark, tmp_path):
    from tessera.operators.campaign import Tables

    tables, rows = Tables(spark, f"file://{tmp_path}/c"), lambda n: spark.createDataFrame([("k", str(n), n)], "key string, value string, turn bigint")
    tables.commit(campaign=rows(0), flags=rows(0))
    (tmp_path / "c" / "campaign" / "crashed").mkdir()
    for n in range(1, 5):
        before = tables.read("campaign")
        tables.commit(campaign=rows(n))
        assert before.first().turn == n - 1 and tables.read("campaign").first().turn == n  # who read before still can
    assert len(list((tmp_path / "c" / "campaign").iterdir())) == 2 and tables.read("flags").first().turn == 0
