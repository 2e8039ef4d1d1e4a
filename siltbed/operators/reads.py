"""Point, batch and range reads. Filters on the key go below the resolution of versions, filters on anything else above it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators.resolve import latest, live


def raw_get(versions: DataFrame, key: Any) -> DataFrame:
    """The latest version of one key, a tombstone too: zero rows or one."""
    return latest(versions.where(F.col("key") == F.lit(key)))


def get(versions: DataFrame, key: Any) -> DataFrame:
    """(key, value, seq) of a live key; no row if it is deleted or absent."""
    return live(raw_get(versions, key))


def get_many(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, found, value) for each distinct probe key.

    The probes first cut the versions by a semi-join, so only their keys are resolved; adaptive execution broadcasts them if
    they are small, and otherwise both sides are dealt by key, which resolution and the last join reuse.
    """
    wanted = probes.select("key").distinct()
    found = live(latest(versions.join(wanted, "key", "left_semi"))).select("key", "value", F.lit(True).alias("found"))
    return wanted.join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")


def absent(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct probe keys that no version has, not even a tombstone."""
    return probes.select("key").distinct().join(versions.select("key"), "key", "left_anti")


def between(versions: DataFrame, start: Any = None, end: Any = None, end_exclusive: bool = False) -> DataFrame:
    """Versions of keys from start to end; None is open."""
    if start is not None:
        versions = versions.where(F.col("key") >= F.lit(start))
    if end is not None:
        versions = versions.where(F.col("key") < F.lit(end) if end_exclusive else F.col("key") <= F.lit(end))
    return versions


def scan(versions: DataFrame, start: Any = None, end: Any = None, end_exclusive: bool = False, limit: int | None = None) -> DataFrame:
    """Live (key, value, seq) by key, both ends included unless end_exclusive; the first `limit` of them."""
    out = live(latest(between(versions, start, end, end_exclusive))).orderBy("key")
    return out if limit is None else out.limit(limit)
