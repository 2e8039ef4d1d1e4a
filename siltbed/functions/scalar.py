"""Record sizes, checksums, key formats and rank percentiles as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.sources.folders import sliced

#: Bytes of a record besides key and value, by encoding.
LOG_RECORD, LOG_RECORD_COMPACT = 21, 25
RUN_RECORD, RUN_RECORD_COMPACT = 21, 17
#: Type codes of log records.
OP_CODES = {"PUT": 0, "DELETE": 1, "CHECKPOINT": 2}


def little_endian(x: Column, octets: int) -> Column:
    """A non-negative integer as so many bytes, the lowest first."""
    swapped = F.lit(0).cast("long")
    for i in range(octets):  # turned by arithmetic: a text of digits, cut and put together, costs twice as much
        octet = F.shiftright(x.cast("long"), 8 * i).bitwiseAND(F.lit(0xFF).cast("long"))
        swapped = swapped.bitwiseOR(F.shiftleft(octet, 8 * (octets - 1 - i)))
    return F.unhex(F.lpad(F.hex(swapped), 2 * octets, "0"))


def _bytes(x: Column) -> Column:
    return F.coalesce(x.cast("binary"), F.lit(b""))


def log_crc(op: Column, seq: Column, key: Column, value: Column) -> Column:
    """CRC-32 (IEEE) of a log record: type, seq, key length, key, value length, value, integers little-endian."""
    code = F.coalesce(*[F.when(op == name, little_endian(F.lit(n), 1)) for name, n in OP_CODES.items()], F.unhex(F.lit("FF")))
    k, v = _bytes(key), _bytes(value)
    return F.crc32(F.concat(code, little_endian(seq, 8), little_endian(F.octet_length(k), 4), k, little_endian(F.octet_length(v), 4), v))


def record_size(key: Column, value: Column, overhead: int) -> Column:
    return (F.octet_length(_bytes(key)) + F.octet_length(_bytes(value)) + overhead).cast("long")


def varint_size(x: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    sizes = F.when(x < 1 << 7, 1)
    for n in range(2, 9):
        sizes = sizes.when(x < 1 << 7 * n, n)
    return sizes.otherwise(9)


def formatted_key(prefix: str, x: Column, width: int) -> Column:
    """The prefix and the number, filled with zeros to a width."""
    return F.concat(F.lit(prefix), F.lpad(x.cast("string"), width, "0"))


def rank_percentiles(df: DataFrame, column: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """(name, value) by rank: the element at floor(n * share) of the ascending values, the last at most; nothing for no rows.

    Exact, without one task that orders all: distinct values are counted and ranged to slices, whose number goes with the session's partitions; the
    slices' totals (a small table) tell where each rank lies, and only those slices are ordered.
    """
    sums = sliced(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value")
    before = F.coalesce(F.sum("m").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sums.groupBy("_slice").agg(F.sum("n").alias("m")).select("_slice", "m", before.alias("before"))
    total = totals.agg(F.sum("m").alias("total")).where("total > 0")
    wanted = df.sparkSession.createDataFrame(list(shares), "name string, share double")
    # One row and a row for each share: broadcast whatever the input.
    ranks = wanted.join(F.broadcast(total)).select("name", F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1).alias("rank"))
    placed = totals.join(F.broadcast(ranks), (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    upto = F.sum("n").over(Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    near = sums.join(F.broadcast(placed), "_slice").select("name", "value", "rank", "n", upto.alias("upto"))
    return near.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("name", "value")
