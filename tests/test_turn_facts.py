"""The memories of the turn stream hold every fact of a turn that the archivist keeps."""

from tessera.plans import state_catalogue  # noqa: F401  registers the query
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_all_facts_of_a_turn_become_memories(spark):
    want, late = {}, 0
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        facts = [t for t in (" ".join(s.split()) for s in (r.text or "").split(". ")) if len(t) >= 8][:12]
        for i, t in enumerate(facts):
            if len(t) >= 12:
                want[str(r.conv_id), f"memory://fact/{r.turn + 1:05d}/{i:02d}"] = t
                late += i >= 3
    got = catalogue.QUERIES["turn_stream"](spark, SF).where("kind = 'fact'").collect()
    assert late and {(r.campaign, r.path): r.text for r in got} == want and len(got) == len(want)
