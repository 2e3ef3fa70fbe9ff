"""The turn log as a stream: memories written once whatever is replayed, state moved only by the latest turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scratch import shared_folder  # noqa: F401  checkpoints of streams go there too
from tessera.operators.turns import memories

TURNS = "campaign string, n bigint, minutes int, location string, summary string, facts array<string>, events array<string>, when string"
MEMORIES = "campaign string, path string, title string, heading string, kind string, turn bigint, text string"
#: Parts of the archive, by a hash of the campaign.
PARTS = 64


def entries_of(turns: DataFrame) -> DataFrame:
    """(kind, turn, when, texts) of archived turns; a turn without a summary has a plain one."""
    summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.concat(F.lit("(turn "), F.col("n").cast("string"), F.lit(") no summary")))
    kinds = F.array(
        F.struct(F.lit("summary").alias("kind"), F.array(summary).alias("texts")),
        F.struct(F.lit("fact").alias("kind"), F.coalesce("facts", F.array().cast("array<string>")).alias("texts")),
        F.struct(F.lit("event").alias("kind"), F.coalesce("events", F.array().cast("array<string>")).alias("texts")),
    )
    return turns.select("campaign", F.col("n").alias("turn"), "when", F.inline(kinds))


class Archive:
    """Folders of memories and turns, in parts by a hash of the campaign; each micro-batch appends what it has not seen, under its own
    batch id, and reads only the parts that its campaigns lie in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str, without: int | None = None, parts: list[int] | None = None) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch bigint, part int").parquet(f"{self.root}/{name}")
        rows = rows if without is None else rows.where(F.col("batch") != without)
        return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("batch", "part")

    def memories(self, without: int | None = None, parts: list[int] | None = None) -> DataFrame:
        return self._read("memories", MEMORIES, without, parts)

    def turns(self, without: int | None = None, parts: list[int] | None = None) -> DataFrame:
        return self._read("turns", TURNS, without, parts)

    def state(self) -> DataFrame:
        """By campaign: the latest turn, all minutes, and the last location that was given. Late turns do not move it."""
        return self.turns().groupBy("campaign").agg(
            F.max("n").alias("turn"), F.sum("minutes").alias("minutes"), F.max_by("location", F.when(F.col("location") != "", F.col("n"))).alias("location")
        )

    def write(self, turns: DataFrame, batch: int) -> None:
        """A batch that is run again sees the archive without itself, and overwrites its own folder only."""
        part = F.pmod(F.xxhash64("campaign"), F.lit(PARTS)).cast("int")
        parts = [r[0] for r in turns.select(part.alias("p")).distinct().collect()]  # at most PARTS numbers
        fresh = turns.dropDuplicates(["campaign", "n"]).join(self.turns(batch, parts).select("campaign", "n"), ["campaign", "n"], "left_anti")
        rows = memories(entries_of(fresh), "campaign").join(self.memories(batch, parts).select("campaign", "path"), ["campaign", "path"], "left_anti")
        for name, found, schema in (("memories", rows, MEMORIES), ("turns", fresh, TURNS)):
            kept = found.select(*[c.split()[0] for c in schema.split(", ")], part.alias("part"))
            kept.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{name}/batch={batch}")

    def run(self, source: DataFrame, checkpoint: str) -> None:
        """Take in all that a stream of turns has now, exactly once."""
        query = source.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

