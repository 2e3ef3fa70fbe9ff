from test_turns import row

from tessera.streaming.keyed_log import BLOCK, KeyedArchive, _Block
from tessera.streaming.turn_log import TURNS


def test_late_repeated_and_unordered_turns_over_batches(spark, tmp_path):
    source, far = tmp_path / "log", BLOCK * 3 + 5
    archive = KeyedArchive(spark, f"file://{tmp_path}/archive")
    batches = [
        [row(1), row(3), row(3), row(far, location=None)],
        [row(2), row(3, summary="another text of turn 3"), row(7, campaign="d", minutes=None, location="")],
        [row(far, summary="the far turn once more"), row(0), row(None), row(-1), row(4, campaign=None), row(4)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, TURNS).coalesce(1).write.mode("append").json(str(source))
        archive.run(spark.readStream.schema(TURNS).json(str(source)), f"{tmp_path}/checkpoint")
    archive.run(spark.readStream.schema(TURNS).json(str(source)), f"{tmp_path}/checkpoint")  # nothing new
    assert sorted((r.campaign, r.n) for r in archive.turns().collect()) == [*(("c", n) for n in (0, 1, 2, 3, 4, far)), ("d", 7)]
    assert archive.memories().where("kind = 'summary' AND turn = 3").first().text == "summary of turn 3"
    assert archive.memories().count() == 14
    state = {r.campaign: (r.turn, r.minutes, r.location) for r in archive.state().collect()}
    assert state == {"c": (far, 150, "place 4"), "d": (7, 0, None)}


def test_a_batch_that_runs_again_overwrites_itself(spark, tmp_path):
    """The commit of a batch is lost with the driver: it runs again from the state before it."""
    source, log = tmp_path / "log", tmp_path / "checkpoint"
    archive = KeyedArchive(spark, f"file://{tmp_path}/archive")
    for turns in ([row(1), row(2)], [row(2), row(3)]):
        spark.createDataFrame(turns, TURNS).coalesce(1).write.mode("append").json(str(source))
        archive.run(spark.readStream.schema(TURNS).json(str(source)), str(log))
    for name in ("1", ".1.crc"):
        (log / "commits" / name).unlink()
    archive.run(spark.readStream.schema(TURNS).json(str(source)), str(log))
    assert sorted(r.n for r in archive.turns().collect()) == [1, 2, 3] and archive.state().first().minutes == 75


def test_one_run_of_several_batches_and_an_empty_log(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    archive = KeyedArchive(spark, f"file://{tmp_path}/archive")
    stream = lambda: spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).json(str(source))
    archive.run(stream(), f"{tmp_path}/checkpoint")
    assert archive.turns().count() == archive.memories().count() == archive.state().count() == 0
    spark.createDataFrame([row(n) for n in range(60)], TURNS).repartition(3).write.mode("append").json(str(source))
    assert len([p for p in archive.run(stream(), f"{tmp_path}/checkpoint") if p["numInputRows"]]) == 3
    assert archive.turns().count() == 60 and archive.state().first().turn == 59


def test_state_has_few_partitions_and_two_calls_for_a_key(spark, tmp_path):
    """Each partition costs a store and a worker in every batch, each call to the store a round trip for every key."""
    calls = []

    class Value:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    block = _Block()
    block.init(type("Handle", (), {"getValueState": lambda *a: Value()})())
    assert len(list(block.handleInputRows(("c", 0), iter([row_of(spark, n) for n in (1, 2, 2)]), None))) == 3 and calls == ["get", "update"]

    before, most = spark.conf.get("spark.sql.shuffle.partitions"), 2 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(most + 3))
    try:
        spark.createDataFrame([row(1)], TURNS).write.json(str(tmp_path / "log"))
        found = KeyedArchive(spark, f"file://{tmp_path}/archive").run(spark.readStream.schema(TURNS).json(str(tmp_path / "log")), f"{tmp_path}/checkpoint")
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(most + 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {s["numShufflePartitions"] for p in found for s in p["stateOperators"]} == {most}


def row_of(spark, n):
    return spark.createDataFrame([row(n)], TURNS).first()
