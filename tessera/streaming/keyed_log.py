"""The turn log with keyed state: which turns were taken in, and where each campaign stands, in Spark's own state store.

A campaign may hold a third of all turns, so its state is kept in blocks of ``BLOCK`` turn numbers: a block is a key of its own,
with one bit for each turn it has seen and a summary of them. The state of a key is bounded, a late turn reads its own block
only, and nothing of the archive is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.turns import memories
from tessera.streaming.turn_log import MEMORIES, TURNS, entries_of

BLOCK = 1024
STAND = "block bigint, turns bigint, turn bigint, minutes bigint, placed bigint, location string"
#: The store that keeps state of this kind, and commits of what a batch has changed, not of its whole files.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_TURN = [c.split()[0] for c in TURNS.split(", ")]


class _Block(StatefulProcessor):
    """Passes each turn of a block on once, then says where the block stands."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value: each call to the store is a round trip for each key
        self.kept = handle.getValueState("kept", "bits binary, turns bigint, turn bigint, minutes bigint, placed bigint, location string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        campaign, block = key
        seen, turns, turn, minutes, placed, location = self.kept.get() or (b"", 0, -1, 0, -1, None)
        bits = int.from_bytes(seen, "little")
        before = turns
        for row in rows:
            bit = 1 << (row.n - block * BLOCK)
            if bits & bit:
                continue
            bits |= bit
            turns, turn, minutes = turns + 1, max(turn, row.n), minutes + (row.minutes or 0)
            if row.location and row.n > placed:
                placed, location = row.n, row.location
            yield Row(**{c: row[c] for c in _TURN}, stand=None)
        if turns > before:
            self.kept.update((bits.to_bytes(-(-bits.bit_length() // 8), "little"), turns, turn, minutes, placed, location))
            yield Row(**{c: None for c in _TURN} | {"campaign": campaign}, stand=Row(block=block, turns=turns, turn=turn, minutes=minutes, placed=placed, location=location))

    def close(self) -> None:
        pass


class KeyedArchive:
    """Folders of turns, memories and stands that a stream appends to, each micro-batch under its own id.

    A batch that runs again starts from the same version of the state and overwrites its own folders, so every turn is there once
    whatever is replayed, repeated or late. Of several turns with one number in a batch any one is taken. Turns without a
    campaign or a number from 0 on have no place in a log and are refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.root}/{name}").drop("batch")

    def turns(self) -> DataFrame:
        return self._read("turns", TURNS)

    def memories(self) -> DataFrame:
        return self._read("memories", MEMORIES)

    def state(self) -> DataFrame:
        """(campaign, turn, minutes, location): the latest turn, all minutes, and the last location that was given. Late turns do not move it.

        A block has a row for each batch that added to it; the one with the most turns is its last."""
        last = self._read("stands", f"campaign string, {STAND}").groupBy("campaign", "block").agg(F.max_by(F.struct("turn", "minutes", "placed", "location"), "turns").alias("s"))
        location = F.max_by("s.location", F.when(F.col("s.location").isNotNull(), F.col("s.placed")))
        return last.groupBy("campaign").agg(F.max("s.turn").alias("turn"), F.sum("s.minutes").alias("minutes"), location.alias("location"))

    def _write(self, rows: DataFrame, batch: int) -> None:
        kept = rows.persist()
        try:
            turns = kept.where("stand IS NULL").select(*_TURN)
            found = memories(entries_of(turns), "campaign").select(*[c.split()[0] for c in MEMORIES.split(", ")])
            for name, df in (("turns", turns), ("memories", found), ("stands", kept.where("stand IS NOT NULL").select("campaign", "stand.*"))):
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        finally:
            kept.unpersist()

    def run(self, source: DataFrame, checkpoint: str, partitions: int | None = None) -> list[dict]:
        """Take in all that a stream of turns has now, exactly once; the progress of the micro-batches.

        ``partitions`` of the state cost a store and a worker each in every micro-batch; without them there are two for each core, or as many
        as the session's shuffles have if these are fewer. A checkpoint keeps the number that it began with."""
        spark = self.spark
        shuffles = "spark.sql.shuffle.partitions"
        conf = _STATE | {shuffles: str(partitions or min(int(spark.conf.get(shuffles)), 2 * spark.sparkContext.defaultParallelism))}
        placed = source.where("campaign IS NOT NULL AND n >= 0").withColumn("block", F.floor(F.col("n") / BLOCK))
        fresh = placed.groupBy("campaign", "block").transformWithState(_Block(), f"{TURNS.replace('when string', '`when` string')}, stand struct<{STAND.replace(' ', ':').replace(',:', ', ')}>", "Append", "None")
        before = {name: spark.conf.get(name, None) for name in conf}
        for name, value in conf.items():
            spark.conf.set(name, value)
        try:
            query = fresh.writeStream.foreachBatch(self._write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for name, value in before.items():
                spark.conf.set(name, value) if value else spark.conf.unset(name)
        return list(query.recentProgress)
