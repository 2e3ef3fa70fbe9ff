from tessera import cli
from tessera.backends import Echo
from tessera.operators import index


def test_commands(spark, tmp_path, capsys):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "handbook.md").write_text("# Employee Handbook\n## Leave\nTwenty five days of leave a year.\n")
    (corpus / "runbook.md").write_text("# Runbook\n## Error E-4471\nRestart the broker when you see E-4471.\n")
    at = ["--index", f"file://{tmp_path}/index"]
    assert cli.main([*at, "doctor"]) == 1
    assert cli.main([*at, "ingest", str(corpus)]) == 0
    assert cli.main([*at, "search", "what does error E-4471 mean"]) == 0
    assert "runbook.md — Error E-4471" in capsys.readouterr().out.split("2. ")[0]
    assert cli.main([*at, "ask", "how many days of leave"]) == 0
    assert "[echo]" in capsys.readouterr().out
    assert cli.main([*at, "stats"]) == 0 and cli.main([*at, "doctor"]) == 0
    assert "handbook.md" not in capsys.readouterr().err
    ix = index.Index(spark, f"file://{tmp_path}/index")
    assert cli.chat(ix, Echo(), 2, ["how many days\n", "\n", "and then?\n", "reset\n", "quit\n", "never\n"]) == 0
    assert capsys.readouterr().out.count("[echo]") == 2
    (tmp_path / "q.jsonl").write_text('# labelled\n{"query": "what does error E-4471 mean", "expect": "Restart the broker"}\n{"query": "days of leave", "expect": ["five days", "nowhere"]}\n')
    assert cli.main([*at, "evaluate", f"file://{tmp_path}/q.jsonl"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split()[0] for x in lines] == ["dense", "bm25", "hybrid", "hybrid+rerank"] and all("coverage 0.667" in x for x in lines[1:])
    assert cli.main([*at, "ask", "days", "of", "leave", "--show-sources"]) == 0 and "handbook.md" in capsys.readouterr().out
    generation = ix.meta()["generation"]
    assert cli.main([*at, "ingest"]) == 0 and ix.meta()["generation"] == generation  # nothing changed, nothing is written
    assert cli.main([*at, "ingest", str(corpus), "/nowhere"]) == 0 and "/nowhere does not exist" in capsys.readouterr().err
    (corpus / "plain.xyz").write_text("A file that is named is read whatever it is called.")
    assert ix.ingest([str(corpus / "plain.xyz")])["added"] == 1
    assert cli.main([*at, "forget", "/nowhere"]) == 1 and cli.main(["--index", f"file://{tmp_path}/other", "ingest"]) == 1
