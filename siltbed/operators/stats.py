"""Counters and reports as aggregates over an operation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _size(column: str) -> Column:
    return F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0))


def as_rows(one: DataFrame) -> DataFrame:
    """A row of counters as (name, value)."""
    return one.unpivot([], list(one.columns), "name", "value")


def engine_stats(operations: DataFrame, sstable_count: Column | int = 0, flush_count: Column | int = 0, bytes_compacted: Column | int = 0) -> DataFrame:
    """The eleven counters (name, value) of operations (kind: PUT, DELETE or GET; key, value; tier: memory or run, of a GET that found its key; rejected: runs a filter spared it).

    bytes_written counts keys and values of PUTs; memtable_size those of operations still in memory (in_memory)."""
    put, get = F.col("kind") == "PUT", F.col("kind") == "GET"
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    size = _size("key") + _size("value")
    fixed = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    one = operations.agg(
        F.count_if(put).alias("writes"),
        F.count_if(get).alias("reads"),
        F.count_if(F.col("kind") == "DELETE").alias("deletes"),
        F.count_if(get & (F.col("tier") == "memory")).alias("mem_hits"),
        F.count_if(get & (F.col("tier") == "run")).alias("sst_hits"),
        total(F.when(get, F.col("rejected")), "bloom_misses"),
        total(F.when(put, size), "bytes_written"),
        total(F.when(F.col("in_memory") & ~get, size), "memtable_size"),
    )
    return as_rows(one.withColumns({"flush_count": fixed(flush_count), "bytes_compacted": fixed(bytes_compacted), "sstable_count": fixed(sstable_count)}))


def server_stats(requests: DataFrame, engine: DataFrame) -> DataFrame:
    """Six counters of requests (connection, open, ok, bytes_in, bytes_out) and the engine's with their prefix."""
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    one = requests.agg(
        F.countDistinct("connection").alias("total_connections"),
        F.countDistinct(F.when(F.col("open"), F.col("connection"))).alias("active_connections"),
        F.count("*").alias("total_requests"),
        F.count_if(~F.col("ok")).alias("errors"),
        total("bytes_in", "bytes_read"),
        total("bytes_out", "bytes_written"),
    )
    return as_rows(one).unionByName(engine.select(F.concat(F.lit("engine_"), "name").alias("name"), "value"))


def as_json(stats: DataFrame) -> DataFrame:
    """One row with the counters as a JSON object, by name."""
    return stats.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("stats"))


def save_rate(saved: Column, read: Column) -> Column:
    """saved / (saved + read), 0 if both are."""
    return F.coalesce(F.try_divide(saved.cast("double"), saved + read), F.lit(0.0))


def ticks(operations: DataFrame, width: str = "1 second", span: str = "day") -> DataFrame:
    """(tick, puts, deletes, total_puts, total_deletes, change: operations more than in the tick before) of operations (ts, op).

    Totals run over the ticks of each span and over a row for each span: no task orders all ticks.
    """
    start = F.window("ts", width)["start"]
    one = operations.groupBy(start.alias("tick")).agg(F.count_if(F.col("op") == "PUT").alias("puts"), F.count_if(F.col("op") == "DELETE").alias("deletes"))
    one = one.withColumns({"_ops": F.col("puts") + F.col("deletes"), "_span": F.date_trunc(span, "tick")})
    spans = one.groupBy("_span").agg(F.sum("puts").alias("_puts"), F.sum("deletes").alias("_deletes"), F.max_by("_ops", "tick").alias("_last"))
    over = Window.orderBy("_span")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x)
    spans = spans.select("_span", earlier("_puts"), earlier("_deletes"), F.coalesce(F.lag("_last").over(over), F.lit(0)).alias("_last"))
    order = Window.partitionBy("_span").orderBy("tick")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return one.join(spans, "_span").select(
        "tick",
        "puts",
        "deletes",
        (F.col("_puts") + F.sum("puts").over(upto)).alias("total_puts"),
        (F.col("_deletes") + F.sum("deletes").over(upto)).alias("total_deletes"),
        (F.col("_ops") - F.coalesce(F.lag("_ops").over(order), "_last")).alias("change"),
    )


def throughput(operations: DataFrame) -> DataFrame:
    """One row (ops, seconds, ops_per_second) from the first to the last ts."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    one = operations.agg(F.count("*").alias("ops"), span.alias("seconds"))
    return one.withColumn("ops_per_second", F.coalesce(F.try_divide(F.col("ops"), F.col("seconds")), F.lit(0.0)))
