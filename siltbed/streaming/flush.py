"""Streams over a log folder.

A restart resumes from the checkpoint; a micro-batch that is repeated after a failure writes the run of the same number again,
so a retry changes nothing. Late records need no watermark: seq decides, not the time of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltbed.engine import Store
from siltbed.operators.resolve import entries, latest


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Records of a Parquet log as they come; files_per_trigger bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def flush_stream(records: DataFrame, runs: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of log records becomes one sorted run of level 0, resolved within itself, below `runs`."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        run = latest(entries(batch)).sortWithinPartitions("key")
        run.write.mode("overwrite").parquet(f"{runs}/level=0/run_id={batch_id}")

    return records.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(records: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch (op, seq, key, value) goes to a store, where its records keep their seq; then what is due is flushed and compacted.

    A repeated micro-batch writes records that are there already, and a late one is hidden by newer records: either way the state is the same.
    """

    def take(batch: DataFrame, _: int) -> None:
        store.ingest(batch)
        store.flush(force=False)
        store.compact_due()

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(records: DataFrame) -> DataFrame:
    """The latest version of each key as streaming state (update or complete mode): (key, seq, tombstone, value)."""
    e = entries(records)
    return e.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("tombstone", "seq").alias("tombstone"), F.max_by("value", "seq").alias("value"))


def streamed_runs(spark: SparkSession, log_path: str, schema: str, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Runs a flush stream over what the log holds and returns the runs it made."""
    query = flush_stream(log_stream(spark, log_path, schema, files_per_trigger), f"{folder}/runs", f"{folder}/stream")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/runs")
