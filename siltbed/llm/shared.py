"""Tables that outlive an executor: written once to the folder that the whole cluster shares, then read back."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.sources.folders import new_folder

_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
BATCH_BYTES = 4 << 20
_READ_ROWS, _READ_DEFAULT = "spark.sql.parquet.columnarReaderBatchSize", 4096
#: Rows that Parquet's reader decodes at once: a task holds all their texts, which may have megabytes each.
READ_ROWS = 64


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of this session have 4 MB instead of the default 64 MB, and the reader's 64 rows instead of 4096; a limit that the user has set stays.

    Both the JVM and the Python worker of each task hold a batch, several times while it grows.
    """
    if spark.conf.get(_LIMIT).rstrip("b") == str(_DEFAULT):
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    if spark.conf.get(_READ_ROWS) == str(_READ_DEFAULT):
        spark.conf.set(_READ_ROWS, str(READ_ROWS))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, computed once and read back from the shared folder: later plans start there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.siltbed_path = path
    return back


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: sizes the work by the data, not by a fixed number of partitions."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def shares(total: int, each: int, least: int = 1) -> int:
    """How many shares of at most about `each` make `total`."""
    return max(least, math.ceil(total / each))
