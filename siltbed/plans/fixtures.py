"""The driver's events as an operation log: event ids are sequence numbers, users and k keys, errors deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0, 9: 0}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, key, op, value, ts)."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    gone = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit(":k"), F.lpad(k, 2, "0")).alias("key"),
        F.when(gone, "DELETE").otherwise("PUT").alias("op"),
        F.when(~gone, F.col("value")).alias("value"),
        "ts",
    )


def count(spark: SparkSession, sf_dir: str) -> int:
    return events(spark, sf_dir).count()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten flushes of the log in order of seq, resolved within each: (key, value, tombstone, seq, run_id, level)."""
    from siltbed.operators.resolve import entries, latest

    each = max(count(spark, sf_dir) // 10, 1)
    log = operations(spark, sf_dir)
    run = F.least(F.floor(F.col("seq") / each), F.lit(9)).cast("long")
    level = F.element_at(F.array(*[F.lit(LEVELS[i]) for i in range(10)]), (F.col("run_id") + 1).cast("int"))
    return latest(entries(log).withColumn("run_id", run), keys=("run_id", "key")).withColumn("level", level)


OPS_SQL = r"""
total as (select count(*) as n from events),
ops as (
  select event_id as seq, printf('u%05d:k%02d', user_id, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int)) as key,
    case when event_type = 'error' then 'DELETE' else 'PUT' end as op, case when event_type <> 'error' then value end as value, ts
  from events
),
entry as (select key, value, op = 'DELETE' as tombstone, seq from ops),
last as (select * from entry qualify row_number() over (partition by key order by seq desc) = 1),
live as (select key, value, seq from last where not tombstone),
runs as (
  select e.*, cast(least(seq // greatest(n // 10, 1), 9) as bigint) as run_id from entry e, total
  qualify row_number() over (partition by least(seq // greatest(n // 10, 1), 9), key order by seq desc) = 1
),
run as (select *, case when run_id <= 3 then 2 when run_id <= 6 then 1 else 0 end as level from runs)
"""
