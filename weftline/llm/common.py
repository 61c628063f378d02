"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points taken as white space by every contract here, as a regex class body.
WS = r"\x20\x09-\x0D"


#: Stands for a null doc_id in keys, so that it is the greatest.
NO_ID = (1 << 63) - 1

#: Tables of keys up to so many rows, some tens of MB, are broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 1 << 18

#: Spark's setting for deleting an execution's shuffle files at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of a batch that goes to a Python worker, about.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and the executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The shuffle files that writing took go when it is done. Else they stay until the driver happens to collect its garbage,
    and all steps' files lie beside each other.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def key_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """of (hash of the keys), n: how many rows have it."""
    return rows.groupBy(F.xxhash64(*keys).alias("of")).agg(F.count(F.lit(1)).alias("n"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, how: str = "left", counts: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """rows joined to groups, which has one row for each value of keys.

    Of values with over 100 rows the 1024 with the most are dealt to `salts` tasks each by the hash of `spread`, and only
    their groups are repeated; any other value has at most a 1024th of the rows. Rows with a null among the keys match
    nothing and are dealt to all tasks. counts: key_counts(rows, keys), where they can be had without another pass.
    """
    counts = key_counts(rows, keys) if counts is None else counts
    frequent = [r["of"] for r in counts.filter("n > 100").orderBy(F.desc("n")).limit(1024).collect()]
    hot = F.xxhash64(*keys).isin(*frequent) if frequent else F.lit(False)
    every, one = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")), F.array(F.lit(0).cast("long"))
    salted = groups.withColumn("_salt", F.explode(F.when(hot, every).otherwise(one)))
    without = F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    place = F.xxhash64(spread)
    dealt = rows.withColumn("_salt", F.when(without, place).when(hot, F.pmod(place, F.lit(salts))).otherwise(0))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, with batches of about BATCH_BYTES: ten thousand texts are some tens of MB, which executor and worker would hold several times, for each task.

    The bound is set for the session, as Spark asks for it when the result is written; one that is set already stays.
    """
    bound, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def listed(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A small table of the driver's, of whole columns: a list of rows would be read by Python workers of its own kind, which then stand beside the others."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema))


def give_back() -> None:
    """Hand memory that a Python worker has freed back to the system: workers outlive their tasks, and stand beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small(df: DataFrame) -> DataFrame:
    """A materialized table of narrow rows, to be broadcast if it is counted to have at most SMALL_ROWS."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def row_keys() -> tuple[Column, Column]:
    """key and text_hash: what a row of documents is told apart by. Rows alike in both have one doc_id and one text."""
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("text_hash")


def keep_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs' own columns, without the rows that marked (key, text_hash, keep) lets go; of rows alike in both one stays.

    Rows that marked doesn't name stay. Texts move only where very many rows go, and rows that are repeated and stay.
    """
    keys = ["key", "text_hash"]
    named = materialize(marked.groupBy(*keys).agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n")).filter(~F.col("keep") | (F.col("n") > 1)).drop("n"), "marked")
    rows = docs.select(*row_keys(), F.struct("*").alias("doc"))
    left = rows.join(small(named.select(*keys)), keys, "left_anti").select("doc.*")
    repeated = named.filter("keep").select(*keys)
    if repeated.isEmpty():
        return left
    return left.unionByName(rows.join(small(repeated), keys, "left_semi").groupBy(*keys).agg(F.first("doc").alias("doc")).select("doc.*"))
