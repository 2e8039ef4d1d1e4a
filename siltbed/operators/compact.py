"""Compaction: which levels are due, and the merge of their runs. It never changes what reads return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.config import Config
from siltbed.functions.scalar import RUN_RECORD, record_size
from siltbed.operators.resolve import latest


def level_state(runs: DataFrame, config: Config = Config()) -> DataFrame:
    """(level, files, bytes, due): level 0 is due by its runs, level 1 by its bytes, the last never."""
    size = record_size(F.col("key"), F.col("value"), RUN_RECORD)
    out = runs.groupBy("level").agg(F.countDistinct("run_id").alias("files"), F.sum(size).alias("bytes"))
    due = F.when(F.col("level") == 0, F.col("files") >= config.level0_runs).when(F.col("level") < config.levels - 1, F.col("bytes") > config.level1_bytes).otherwise(False)
    return out.withColumn("due", due)


def read_order(runs: DataFrame) -> DataFrame:
    """(level, run_id) as reads go through them: upper levels first, the newest run first within a level."""
    return runs.select("level", "run_id").distinct().orderBy("level", F.col("run_id").desc())


def merged(runs: DataFrame, levels: Sequence[int], bottom: bool) -> DataFrame:
    """The one run that replaces all runs of these levels: the latest version of each key, tombstones dropped only at the bottom.

    `bottom`: no deeper level has any of the keys. A tombstone dropped above that would bring older versions back.
    """
    out = latest(runs.where(F.col("level").isin(*levels)), order=("seq", "run_id")).select("key", "value", "tombstone", "seq")
    return out.where(~F.col("tombstone")) if bottom else out
