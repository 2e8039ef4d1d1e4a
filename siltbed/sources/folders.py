"""Folders that the whole cluster shares: below spark.checkpoint.dir, or, only where that is unset, below one of our own."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="siltbed-")
    return _own["dir"]


def _resolved(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; Spark removes it when the session's JVM ends."""
    path = f"{shared_folder(spark)}/siltbed/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop, system = _resolved(spark, path)
    system.deleteOnExit(hadoop)
    return path


def sweep(spark: SparkSession, seconds: float = 7 * 86_400) -> int:
    """Removes what other applications left (a driver that is killed removes nothing) and have not added to for so long; how many had."""
    own = spark.sparkContext.applicationId
    hadoop, system = _resolved(spark, f"{shared_folder(spark)}/siltbed")
    if not system.exists(hadoop):
        return 0
    old = [x.getPath() for x in system.listStatus(hadoop) if x.getPath().getName() != own and x.getModificationTime() / 1000 < time.time() - seconds]
    for path in old:
        system.delete(path, True)
    return len(old)


def remove_folder(spark: SparkSession, path: str) -> None:
    hadoop, system = _resolved(spark, path)
    system.delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _resolved(spark, path)
    return system.exists(hadoop)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(df: DataFrame, *by: str) -> DataFrame:
    """df ranged by columns, with `_slice`, the number of its range: running values go within slices, in parallel, and over a row for each slice.

    Written, so that whoever reads it twice finds the same slices.
    """
    return written(df.repartitionByRange(*by).withColumn("_slice", F.spark_partition_id()), "sliced")
