"""The operation log: records (op, seq, key, value, crc) in Parquet files, appended batch by batch.

A store's records also have `pos`, their place in the order of appends, and `epoch`, the number of the writer that appended them.
`seq` decides which version of a key counts, `pos` where the log ends; they differ where records come late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.scalar import LOG_RECORD, log_crc, record_size
from siltbed.sources.folders import exists, remove_folder

SCHEMA = "op string, seq long, key binary, value binary, crc long, pos long, epoch long"
CHECKPOINT_KEY = b"__checkpoint__"


def with_crc(records: DataFrame) -> DataFrame:
    """records (op, seq, key, value, and pos and epoch if they have them) with their checksum."""
    own = [c for c in ("pos", "epoch") if c in records.columns]
    typed = records.select("op", "seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), *own)
    return typed.withColumn("crc", log_crc(F.col("op"), F.col("seq"), F.col("key"), F.col("value")))


def append(records: DataFrame, path: str) -> None:
    with_crc(records).write.mode("append").parquet(path)


def checkpoint(spark: SparkSession, seq: int, path: str) -> None:
    """Marks that all records up to seq are in runs."""
    append(spark.createDataFrame([("CHECKPOINT", seq, CHECKPOINT_KEY, None)], "op string, seq long, key binary, value binary").coalesce(1), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records; a log that isn't there is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def intact() -> Column:
    return F.col("crc").eqNullSafe(log_crc(F.col("op"), F.col("seq"), F.col("key"), F.col("value")))


def valid_prefix(log: DataFrame, order: str = "seq") -> DataFrame:
    """Records before the first, by `order`, whose checksum is wrong: a torn tail ends a log. One aggregate, its one row broadcast."""
    bad = log.where(~intact()).agg(F.min(order).alias("_bad"))
    return log.where(F.col(order).isNotNull()).join(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def replay(log: DataFrame, after: int | None = None, order: str = "seq") -> DataFrame:
    """PUT and DELETE records of the valid prefix, only those behind `after` if a checkpoint is given.

    What a checkpoint covers is in runs already, so a bad record there ends nothing; and as the checkpoint is a filter on a
    stored column, files that lie before it are skipped by their statistics.
    """
    records = log if after is None else log.where(F.col(order) > after)
    return valid_prefix(records, order).where(F.col("op") != "CHECKPOINT")


def last_checkpoint(log: DataFrame) -> int | None:
    return log.where("op = 'CHECKPOINT'").agg(F.max("seq")).first()[0]


def size(log: DataFrame) -> DataFrame:
    """One row (records, bytes) as the binary encoding counts them."""
    return log.agg(F.count("*").alias("records"), F.coalesce(F.sum(record_size(F.col("key"), F.col("value"), LOG_RECORD)), F.lit(0).cast("long")).alias("bytes"))


def spent(spark: SparkSession, path: str, upto: int) -> list[str]:
    """The log's files whose records all have pos <= upto, checkpoint marks among them; a file with a later record is not spent."""
    place = F.coalesce("pos", F.when(F.col("op") == "CHECKPOINT", F.lit(-1)).otherwise(F.col("seq")))
    tops = read(spark, path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(place).alias("top")) if exists(spark, path) else None
    return [] if tops is None else [r.file for r in tops.where(F.col("top") <= upto).collect()]  # a row for each file


def rotate(spark: SparkSession, path: str, upto: int) -> int:
    """Deletes the spent files, and returns how many."""
    files = spent(spark, path, upto)
    for file in files:
        remove_folder(spark, file)
    return len(files)


def delete(spark: SparkSession, path: str) -> None:
    remove_folder(spark, path)
