"""Which version of a key counts: the one of highest seq; on a tie the one of the highest run; tombstones hide what is older."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose latest value a hash aggregation can keep in place.
_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def entries(log: DataFrame) -> DataFrame:
    """PUT and DELETE records of a log as (key, value, tombstone, seq); other records are no entries."""
    gone = F.col("op") == "DELETE"
    return log.where(F.col("op").isin("PUT", "DELETE")).select("key", F.when(~gone, F.col("value")).alias("value"), gone.alias("tombstone"), "seq")


def latest(versions: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """One row for each key, all columns of its latest version.

    With one order column and fixed-width others, a hash aggregation with partial sums: of a hot key one row leaves each task.
    Else row_number, whose group limit also keeps one row for each key before the shuffle.
    """
    rest = [f for f in versions.schema.fields if f.name not in keys and f.name not in order]
    if len(order) == 1 and all(isinstance(f.dataType, _FIXED) for f in rest):
        # A null must win like any other value, and max_by passes over null orders only.
        out = versions.groupBy(*keys).agg(F.max(order[0]).alias(order[0]), *[F.max_by(f.name, order[0]).alias(f.name) for f in rest])
        return out.select(versions.columns)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(x).desc() for x in order]))
    return versions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def live(resolved: DataFrame) -> DataFrame:
    """Without deleted keys. Only right after latest(): a tombstone must first have hidden older versions."""
    return resolved.where(~F.col("tombstone")).drop("tombstone")


def merge(sources: Sequence[DataFrame], order: Sequence[str] = ("seq",)) -> DataFrame:
    """The latest versions over several sources, tombstones kept."""
    return latest(reduce(DataFrame.unionByName, sources), order=order)


def snapshot(versions: DataFrame, upto: int | None = None) -> DataFrame:
    """Latest versions, tombstones included, by key; with upto, as of that seq."""
    seen = versions if upto is None else versions.where(F.col("seq") <= upto)
    return latest(seen).orderBy("key")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change: added, removed or changed, old_value, new_value) between two live states (key, value, seq)."""
    a = before.select("key", F.col("value").alias("old_value"), F.col("seq").alias("old_seq"))
    b = after.select("key", F.col("value").alias("new_value"), F.col("seq").alias("new_seq"))
    change = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").otherwise("changed")
    both = a.join(b, "key", "full").where(~F.col("old_seq").eqNullSafe(F.col("new_seq")))
    return both.select("key", change.alias("change"), "old_value", "new_value")


def recovery(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row (recovered, missing, wrong, unexpected) from two tables (key, value)."""
    a = expected.select("key", F.struct("value").alias("want"))
    b = actual.select("key", F.struct("value").alias("got"))
    want, got = F.col("want"), F.col("got")
    both = want.isNotNull() & got.isNotNull()
    same = want["value"].eqNullSafe(got["value"])
    count = lambda holds, name: F.count_if(holds).alias(name)
    return a.join(b, "key", "full").agg(count(both & same, "recovered"), count(got.isNull(), "missing"), count(both & ~same, "wrong"), count(want.isNull(), "unexpected"))
