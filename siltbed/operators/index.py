"""What is known of a run without reading it: bounds, a sparse index, a Bloom filter. All as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.scalar import RUN_RECORD, record_size
from siltbed.operators.resolve import latest
from siltbed.sources.folders import sliced, written


def run_metadata(runs: DataFrame) -> DataFrame:
    """(run_id, level, num_entries, num_tombstones, smallest, largest, min_seq, max_seq, file_size: bytes of its records)."""
    return runs.groupBy("run_id", "level").agg(
        F.count("*").alias("num_entries"),
        F.count_if("tombstone").alias("num_tombstones"),
        F.min("key").alias("smallest"),
        F.max("key").alias("largest"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.sum(record_size(F.col("key"), F.col("value"), RUN_RECORD)).alias("file_size"),
    )


def run_bounds(runs: DataFrame) -> DataFrame:
    """(run_id, level, smallest, largest): a row for each run."""
    return runs.groupBy("run_id", "level").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"))


#: Tables of a row for each run are broadcast up to so many.
MOST_RUNS = 10_000


def few(table: DataFrame) -> DataFrame:
    """A table of a row for each run, by hint of broadcast if it has MOST_RUNS rows at most; computed here, once."""
    rows = table.limit(MOST_RUNS + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if len(rows) <= MOST_RUNS else table


def candidate_runs(metadata: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, run_id, level): the runs whose bounds hold a probe key."""
    bounds = few(metadata.select("run_id", "level", "smallest", "largest"))
    return probes.select("key").join(bounds, F.col("key").between(F.col("smallest"), F.col("largest"))).select("key", "run_id", "level")


def _earlier(slices: DataFrame, *sums: str) -> DataFrame:
    """A row for each (run_id, _slice): the sums over the run's earlier slices."""
    before = Window.partitionBy("run_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select("run_id", "_slice", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in sums])


def sparse_index(runs: DataFrame, interval: int = 16, first_offset: int = 8) -> DataFrame:
    """(run_id, key, offset): every interval-th key of a run and the byte offset of its record, the data starting at first_offset.

    Numbers and offsets run within slices of a run and over slice totals: a run of any size is many tasks' work.
    """
    placed = sliced(runs.select("run_id", "key", record_size(F.col("key"), F.col("value"), RUN_RECORD).alias("size")), "run_id", "key")
    earlier = _earlier(placed.groupBy("run_id", "_slice").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes")), "_n", "_bytes")
    order = Window.partitionBy("run_id", "_slice").orderBy("key")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = placed.select("run_id", "_slice", "key", F.row_number().over(order).alias("_i"), before.alias("_before"))
    marks = local.join(earlier, ["run_id", "_slice"]).where((F.col("_n") + F.col("_i") - 1) % interval == 0)
    return marks.select("run_id", "key", (F.col("_bytes") + F.col("_before") + first_offset).cast("long").alias("offset"))


def seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(run_id, key, offset) for probes (run_id, key): the offset of the last index key that isn't larger; -1 if all are.

    An as-of join without a range join: index keys and probes are ranged together by run and key, each probe takes the last offset
    of its slice, or else the last of the slices before.
    """
    marks = index.select("run_id", "key", F.lit(0).alias("_probe"), "offset").unionByName(probes.select("run_id", "key").distinct().select("run_id", "key", F.lit(1).alias("_probe"), F.lit(None).cast("long").alias("offset")))
    placed = sliced(marks, "run_id", "key")
    upto = Window.partitionBy("run_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("run_id", "_slice").agg(F.max("offset").alias("_top")).select("run_id", "_slice", F.max("_top").over(upto).alias("_carried"))
    last = F.last("offset", ignorenulls=True).over(Window.partitionBy("run_id", "_slice").orderBy("key", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("_last", last).where("_probe = 1").join(carried, ["run_id", "_slice"])
    return found.select("run_id", "key", F.coalesce("_last", "_carried", F.lit(-1).cast("long")).alias("offset"))


def bloom_size(keys: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits (a multiple of 64) and hashes of a filter for so many keys at a rate of false positives."""
    bits = max(64, -(-math.ceil(-max(keys, 1) * math.log(rate) / math.log(2) ** 2) // 64) * 64)
    return bits, max(1, min(20, round(bits / max(keys, 1) * math.log(2))))


#: Keys of the largest run that a slice of the filters has.
SLICE_KEYS = 1_000


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(slices)).alias("slice")


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("one"), F.xxhash64(F.lit(1), key).alias("two"))


def _positions(hashed: Column, bits: Column, hashes: int) -> Column:
    """Double hashing: position i is (h1 + i * h2) modulo the bits."""
    first, second = F.pmod(hashed["one"], bits), F.pmod(hashed["two"], bits)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(first + i * second, bits))


def _may_have(hashed: Column, bits: Column, words: Column, hashes: int) -> Column:
    word = lambda at: F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
    return F.forall(_positions(hashed, bits, hashes), lambda at: F.call_function("shiftright", word(at), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)


def bloom_build(runs: DataFrame, bits_per_key: float = 9.6, hashes: int = 10) -> DataFrame:
    """(slices, slice, run_id, bits, words): each run's filter in slices by a hash of the key, the same hash for all runs; words of 64 bits.

    A key is shuffled once, to its slice, where its bits are set; the filter of one run may be larger than any task's memory. Written, as
    probes read it more than once.
    """
    largest = runs.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    slices = max(1, math.ceil(largest / SLICE_KEYS))
    dealt = runs.select("run_id", "key", _slice(F.col("key"), slices)).repartition("slice")
    keys = dealt.groupBy("run_id", "slice").agg(F.count("*").alias("n"), F.collect_list(_hashes(F.col("key"))).alias("hashed"))
    keys = keys.withColumn("bits", F.greatest(F.floor(F.col("n") * bits_per_key), F.lit(64)).cast("long"))
    mask = lambda at: F.struct(F.floor(at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("mask"))
    own = F.transform(F.flatten(F.transform("hashed", lambda h: _positions(h, F.col("bits"), hashes))), mask)
    none = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bits") - 1) / 64).cast("long")), lambda w: F.struct(w.alias("word"), F.lit(0).cast("long").alias("mask")))
    set_ = keys.select("run_id", "slice", "bits", F.explode(F.concat(own, none)).alias("at")).groupBy("run_id", "slice", "bits", "at.word").agg(F.bit_or("at.mask").alias("mask"))
    words = F.sort_array(F.collect_list(F.struct("word", "mask")))["mask"].alias("words")
    return written(set_.groupBy("run_id", "slice", "bits").agg(words).select(F.lit(slices).alias("slices"), "slice", "run_id", "bits", "words"), "bloom")


def _slices(bloom: DataFrame) -> int:
    one = bloom.select("slices").first()
    return one.slices if one else 1


def bloom_probe(bloom: DataFrame, probes: DataFrame, bounds: DataFrame, hashes: int = 10) -> DataFrame:
    """(run_id, key, maybe) for each probe key and each run whose bounds hold it: False is certain. No row: the bounds rule the run out.

    A key is shuffled once for all runs, to its slice, which has the slices of all their filters; its rows for each run are made there.
    """
    asked = probes.select("key").distinct().select("key", _slice(F.col("key"), _slices(bloom)))
    filters = bloom.groupBy("slice").agg(F.collect_list(F.struct("run_id", "bits", "words")).alias("filters"))
    every = bloom.agg(F.collect_set("run_id").alias("every"))  # one row
    told = asked.join(filters, "slice", "left").join(F.broadcast(every)).withColumn("hashed", _hashes(F.col("key")))
    answer = lambda run, maybe: F.struct(run.alias("run_id"), maybe.alias("maybe"))
    some = F.transform("filters", lambda f: answer(f["run_id"], _may_have(F.col("hashed"), f["bits"], f["words"], hashes)))
    # Runs that have no key in the slice have no filter there.
    none = F.transform(F.array_except("every", F.coalesce(F.transform("filters", lambda f: f["run_id"]), F.array().cast(every.schema["every"].dataType))), lambda run: answer(run, F.lit(False)))
    told = told.select("key", F.explode(F.coalesce(F.concat(some, none), none)).alias("told")).select("key", "told.*")
    edges = few(bounds.select("run_id", "smallest", "largest"))
    return told.join(edges, "run_id").where(F.col("key").between(F.col("smallest"), F.col("largest"))).select("run_id", "key", "maybe")


def bloom_own(bloom: DataFrame, keys: DataFrame, hashes: int = 10) -> DataFrame:
    """(run_id, key, maybe) for keys (run_id, key), each asked of its run's filter alone."""
    asked = keys.select("run_id", "key", _slice(F.col("key"), _slices(bloom)))
    told = asked.join(bloom.select("slice", "run_id", "bits", "words"), ["slice", "run_id"], "left")
    return told.select("run_id", "key", F.coalesce(_may_have(_hashes(F.col("key")), F.col("bits"), F.col("words"), hashes), F.lit(False)).alias("maybe"))


def answering_run(runs: DataFrame) -> DataFrame:
    """(key, run_id, level, deleted, runs_probed): where a read that goes from the newest run to older ones ends, and after how many runs.

    Every run newer than the answering one is probed too, if its bounds hold the key; the last run that has the key in (seq, run) order answers.
    """
    answer = latest(runs.select("key", "run_id", "level", "tombstone", "seq"), order=("seq", "run_id"))
    bounds = few(run_bounds(runs).select(F.col("run_id").alias("_run"), "smallest", "largest"))
    probed = answer.join(bounds, (F.col("_run") >= F.col("run_id")) & F.col("key").between(F.col("smallest"), F.col("largest")))
    return probed.groupBy("key", "run_id", "level", F.col("tombstone").alias("deleted")).agg(F.count("*").alias("runs_probed"))
