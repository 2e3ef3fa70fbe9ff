"""What the training-data operators share: table access, scratch tables, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Whether a query's shuffle files go when it ends. Else they stay until the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, *, clean: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and survives lost executors.

    The folder is the application's own and is deleted when that ends; :func:`discard` deletes a table before. With ``clean``, the
    shuffle files of the write go when it ends: nothing reads them again, as the table is read instead."""
    spark = df.sparkSession
    folder = f"{scratch_root(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)  # when the application ends
    schema = df.schema
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, str(clean or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table of :func:`materialise` that no later step reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, *, by: str, how: str = "inner", parts: int = 16) -> DataFrame:
    """``left`` with the row of ``right`` that has its key, where a third of ``left`` may have the same key.

    The rows of each key are dealt to ``parts`` tasks by a hash of the column ``by``, and ``right``, which has one row for each
    key, is repeated as often; it is never broadcast, as Spark does not count what it is repeated to."""
    own = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return own.join(each.hint("merge"), [key, "_salt"], how).drop("_salt")


def hot_keys(counts: DataFrame, key: str, n: str, share: int = 256) -> list:
    """Keys that hold more than 1 / ``share`` of all rows, so fewer than ``share`` of them, from the counts of each."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * share > total).select(key).collect()]


def remainder5(col: str) -> Column:
    """crc32(id as text) mod 5; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5


#: Rows of whole texts that go to a Python worker at once, where the session has not set another number.
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Spark's usual 10,000 rows at once would make a worker hold hundreds of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under internal names, so that other columns of the table cannot clash."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def batches(chunks: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each Arrow batch as Python lists."""
    for batch in chunks:
        if batch.num_rows:
            yield batch.to_pydict()


def labelled_sample(labels: DataFrame, value: str, bound: int, *, held_out: int | None = 0) -> DataFrame:
    """At most ``bound`` labelled ids, the same ones in every run: those with the smallest hashes.

    Rows with a null id or label are left out; an id with several labels takes the smallest. ``held_out`` names the
    remainder of crc32(id) mod 5 that is never taken (None: take any). The result has ``id`` and ``label`` and, being
    bounded, may be broadcast.
    """
    rows = only(labels, id="doc_id", label=value).where("id IS NOT NULL AND label IS NOT NULL")
    if held_out is not None:
        rows = rows.where(remainder5("id") != held_out)
    return smallest(rows.groupBy("id").agg(F.min("label").alias("label")), "id", bound)


def smallest(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those whose key has the smallest hashes; keys are distinct.

    Rows above a hash that some 2 * bound + 100 rows lie below are dropped first, so that tasks send little to be merged.
    With hashes spread evenly, fewer than ``bound`` remain with a probability under exp(-bound / 4 - 25).
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    n = rows.count()
    wanted = 2 * bound + 100
    if n > wanted:
        rows = rows.where(place <= int((1 << 30) * wanted / n))
    return rows.orderBy(place, key).limit(bound)
