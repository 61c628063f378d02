"""The engine's stream operators over what is stored, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog.registry import query, scratch
from weftline.catalog.text import tokens_sql
from weftline.streaming import tokens as st


def _run(spark: SparkSession, sf: str, name: str, build, mode: str = "append") -> DataFrame:
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder = path if _is_folder(spark, path) else sf
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder == path else f"{name}.parquet").parquet(folder)
    return st.run_to_end(build(stream), scratch(spark, "stream"), mode)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def streamed_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by ten minutes and type, as a stream in complete mode."""
    found = _run(spark, sf, "events", lambda s: st.event_counts(s, "10 minutes"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
    WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM g GROUP BY user_id, run
""")
def streamed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's events without a gap of half an hour, as a stream in complete mode."""
    found = _run(spark, sf, "events", lambda s: st.sessions(s, "30 minutes"), "complete")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 10 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def streamed_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The same in append mode: a window comes out once, when the watermark has passed it, and its state goes."""
    found = _run(spark, sf, "events", lambda s: st.event_counts(s, "10 minutes", late="1 hour"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"WITH {tokens_sql('documents', 'doc_id')} SELECT word, count(*) AS n FROM tk GROUP BY word")
def streamed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of documents that arrive as a stream."""
    return _run(spark, sf, "documents", lambda s: st.token_stream(s).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "complete")
