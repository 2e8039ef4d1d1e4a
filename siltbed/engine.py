"""A store: put, delete, get, scan, flush, compact, recover. Writes come in batches; single-record calls are batches of one."""

from __future__ import annotations

import threading
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from siltbed.config import Config
from siltbed.functions.scalar import LOG_RECORD, record_size
from siltbed.operators import reads
from siltbed.operators.compact import merged
from siltbed.operators.resolve import entries, latest
from siltbed.operators.stats import as_json
from siltbed.sources import log
from siltbed.sources.runs import Replaced, RunStore

#: Records of a log file, where a batch has more.
FILE_RECORDS = 100_000


class Store:
    """All state is in the folder: a log, runs and a manifest. Opening a folder recovers it.

    One writer, any number of readers. A store becomes the writer with its first write: it takes the next epoch in the manifest, and
    every later write of the store that was the writer before raises Replaced. Records that such a store still manages to append lie
    beyond its epoch and are never read. The log ends at the first bad record behind the checkpoint; the next write starts an epoch
    there, so it is read, and what lay behind the bad record is not.

    A DataFrame that a read returns is a snapshot of the runs listed when it was made; files that cease to count stay for
    config.grace_seconds. Calls may come from several threads.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config = Config()) -> None:
        self.spark, self.config = spark, config
        self.store = RunStore(spark, folder)
        self.log_path = f"{self.store.folder}/log"
        self.writing = False
        self._lock = threading.RLock()
        self._counts = dict.fromkeys(("writes", "deletes", "reads", "mem_hits", "sst_hits", "bloom_misses", "bytes_written"), 0)

    # The log

    def _own(self) -> Column:
        """Records that count: of each epoch those before the next one's first."""
        epochs = self.store.manifest.epochs
        ends = [first for _, first in epochs[1:]] + [None]
        each = [(F.col("epoch") == e) & (F.col("pos") >= first) & (F.lit(True) if end is None else F.col("pos") < end) for (e, first), end in zip(epochs, ends, strict=False)]
        return reduce(Column.__or__, each, F.lit(False))

    def _log(self) -> DataFrame:
        m = self.store.manifest
        return log.read(self.spark, self.log_path).where(F.col("pos") > m.checkpoint).where(self._own())

    def _records(self) -> DataFrame:
        return log.replay(self._log(), order="pos")

    def pending(self) -> DataFrame:
        """Entries of the log that no run has yet."""
        return entries(self._records())

    def _claim(self) -> None:
        """Makes this store the writer, behind the last good record of the log."""
        if self.writing and self.store.newest() != self.store.manifest.version:
            raise Replaced(f"{self.store.folder} has another writer")
        if not self.writing:
            self.store.reload()
        m = self.store.manifest
        end = self._log().agg(F.max("pos").alias("pos"), F.max("seq").alias("seq"), F.min(F.when(~log.intact(), F.col("pos"))).alias("bad")).first()
        if self.writing and end.bad is None:
            return
        m.next_pos = end.bad if end.bad is not None else max(m.next_pos, (end.pos or 0) + 1)
        m.next_seq = max(m.next_seq, (end.seq or 0) + 1)
        ends = [first for _, first in m.epochs[1:]] + [m.next_pos]
        taken = max([0, *(e for e, _ in m.epochs)])
        m.epochs = [x for x, end in zip(m.epochs, ends, strict=False) if end > m.checkpoint + 1]  # what else there is, runs have
        m.epochs.append([taken + 1, m.next_pos])
        self.store.save()
        self.writing = True

    # Writes

    def apply(self, records: DataFrame) -> None:
        """records (op: PUT or DELETE, key, value) in the DataFrame's order: of a key that comes more than once, the last counts.

        With a column seq, records keep theirs, and the highest seq of a key counts whenever it comes; what is written later without
        one counts over all of them.
        """
        with self._lock:
            long = F.octet_length(F.col("key").cast("binary"))
            wrong = F.col("key").isNull() | (long < 1) | (long > self.config.key_bytes) | ~F.col("op").isin("PUT", "DELETE")
            told = records.agg(F.count_if(wrong).alias("wrong"), F.count("*").alias("n")).first()
            if told.wrong:
                raise ValueError(f"a key must have 1 to {self.config.key_bytes} bytes, and op be PUT or DELETE")
            self._claim()
            m = self.store.manifest
            place = F.monotonically_increasing_id()
            if "seq" in records.columns and not m.foreign:
                m.foreign = True
                self.store.save()
            seq = F.col("seq") if "seq" in records.columns else place + m.next_seq
            value = F.when(F.col("op") == "PUT", F.col("value")).cast("binary")
            rows = records.select("op", seq.cast("long").alias("seq"), "key", value.alias("value"), (place + m.next_pos).alias("pos"), F.lit(m.epochs[-1][0]).cast("long").alias("epoch"))
            if told.n > FILE_RECORDS:  # a batch may lie in one task, and each file of the log is read by one
                rows = rows.repartition(-(-told.n // FILE_RECORDS), "pos")
            put = F.col("op") == "PUT"
            size = F.octet_length(F.col("key").cast("binary")) + F.coalesce(F.octet_length("value"), F.lit(0))
            seen = Observation()
            seen_rows = rows.observe(seen, F.max("pos").alias("pos"), F.max("seq").alias("seq"), F.count_if(put).alias("puts"), F.count_if(~put).alias("deletes"), F.sum(F.when(put, size)).alias("bytes"))
            log.append(seen_rows, self.log_path)
            wrote = seen.get
            m.next_pos = max(m.next_pos, (wrote["pos"] or 0) + 1)
            m.next_seq = max(m.next_seq, (wrote["seq"] or 0) + 1)
            self._counts["writes"] += wrote["puts"]
            self._counts["deletes"] += wrote["deletes"]
            self._counts["bytes_written"] += wrote["bytes"] or 0

    def put_all(self, records: DataFrame) -> None:
        """records (key, value): of a key that comes more than once, the last in the DataFrame's order counts."""
        self.apply(records.select(F.lit("PUT").alias("op"), "key", "value"))

    def delete_all(self, keys: DataFrame) -> None:
        """Blind: a key needs not exist."""
        self.apply(keys.select(F.lit("DELETE").alias("op"), "key", F.lit(None).cast("binary").alias("value")))

    def ingest(self, records: DataFrame) -> None:
        """records (op, seq, key, value) of another log; other ops are passed over. Late and repeated records change nothing that is newer."""
        self.apply(records.where(F.col("op").isin("PUT", "DELETE")).select("op", "seq", "key", "value"))

    def put(self, key: bytes, value: bytes) -> None:
        self.put_many([(key, value)])

    def put_many(self, pairs: Iterable[tuple[bytes, bytes]]) -> None:
        """Pairs from the driver, in order."""
        rows = [(bytearray(k), bytearray(v)) for k, v in pairs]
        self.put_all(self.spark.createDataFrame(rows, "key binary, value binary").coalesce(1))

    def delete(self, key: bytes) -> None:
        self.delete_all(self.spark.createDataFrame([(bytearray(key),)], "key binary").coalesce(1))

    # Reads

    def refresh(self) -> None:
        """Of a store that isn't the writer: what the writer has changed since."""
        if not self.writing and self.store.newest() != self.store.manifest.version:
            self.store.reload()

    def versions(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """(key, value, tombstone, seq, level: -1 in the log) of all entries that may count, of runs that may have keys from low to high."""
        self.refresh()
        runs = self.store.read(low=low, high=high).select("key", "value", "tombstone", "seq", "level")
        return self.pending().withColumn("level", F.lit(-1)).unionByName(runs)

    def get(self, key: bytes) -> bytes | None:
        """The value of a live key. Runs whose bounds don't hold the key aren't read, and of the others only pages whose filter may."""
        with self._lock:
            found = reads.raw_get(self.versions(key, key), bytearray(key)).first()
            self._counts["reads"] += 1
            # Runs that their bounds rule out; what Parquet's filters rule out beyond them isn't told to anyone.
            self._counts["bloom_misses"] += len(self.store.manifest.runs) - len(self.store.listed(low=key, high=key))
            if found is None or found.tombstone:
                return None
            self._counts["mem_hits" if found.level < 0 else "sst_hits"] += 1
            return bytes(found.value)

    def get_many(self, probes: DataFrame) -> DataFrame:
        """(key, found, value) for each distinct probe key. The probes are counted, and their bounds found, at once; where they were found isn't."""
        probes = probes.select(F.col("key").cast("binary").alias("key"))
        ends = probes.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).first()
        with self._lock:
            self._counts["reads"] += ends.n
            edge = lambda x: None if x is None else bytes(x)
            return reads.get_many(self.versions(edge(ends.low), edge(ends.high)).drop("level"), probes)

    def scan(self, start: bytes | None = None, end: bytes | None = None, end_exclusive: bool = False, limit: int | None = None) -> DataFrame:
        edge = lambda x: None if x is None else bytearray(x)
        with self._lock:
            return reads.scan(self.versions(start, end).drop("level"), edge(start), edge(end), end_exclusive, limit)

    def snapshot(self) -> DataFrame:
        """Latest versions, tombstones included, by key."""
        with self._lock:
            return latest(self.versions().drop("level")).orderBy("key")

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    # Upkeep

    def _end(self) -> Row:
        """(pos, bytes) of what is pending."""
        return self._records().agg(F.max("pos").alias("pos"), F.sum(record_size(F.col("key"), F.col("value"), LOG_RECORD)).alias("bytes")).first()

    def flush(self, force: bool = True) -> bool:
        """Pending entries become a run of level 0; without force, only from config.flush_bytes on."""
        with self._lock:
            self.refresh()
            end = self._end()
            if end.pos is None or not force and end.bytes < self.config.flush_bytes:
                return False
            writing = self.writing
            self._claim()
            if not writing:  # what was pending may be in another writer's run by now
                end = self._end()
                if end.pos is None:
                    return False
            m = self.store.manifest
            run, m.next_run = m.next_run, m.next_run + 1
            # What _end() has found intact isn't checked again.
            line = self.store.write(latest(entries(self._log().where(F.col("pos") <= end.pos))), 0, run, self.config.run_ndv)
            m.runs.append(line)
            m.checkpoint, m.flushes = end.pos, m.flushes + 1
            self.store.retire(log.spent(self.spark, self.log_path, end.pos))
            self.store.save()
            log.checkpoint(self.spark, end.pos, self.log_path)
            self.store.vacuum(self.config.grace_seconds)
            return True

    def compact(self, level: int) -> None:
        """All runs of a level and the next become one run of the next. Fails, and changes nothing, if an input can't be read."""
        with self._lock:
            self.refresh()
            if not self.store.listed([level]):
                return
            self._claim()
            m = self.store.manifest
            old = self.store.listed([level, level + 1])
            if not any(x[0] == level for x in old):
                return
            bottom = not any(x[0] > level + 1 for x in m.runs) and (self.config.in_order or not m.foreign)
            run = m.next_run
            line = self.store.write(merged(self.store.read(only=old), [level, level + 1], bottom), level + 1, run, self.config.run_ndv)
            m.next_run += 1
            m.runs = [x for x in m.runs if x not in old] + ([line] if line[4] else [])
            m.compactions, m.bytes_compacted = m.compactions + 1, m.bytes_compacted + sum(x[5] for x in old)
            self.store.retire([self.store.path(*x[:2]) for x in old])
            self.store.save()
            self.store.vacuum(self.config.grace_seconds)

    def due(self) -> list[int]:
        """Levels to compact, from the manifest alone: level 0 by its runs, others but the last by their bytes."""
        self.refresh()
        of = lambda level: [x for x in self.store.manifest.runs if x[0] == level]
        big = [n for n in range(1, self.config.levels - 1) if sum(x[5] for x in of(n)) > self.config.level1_bytes]
        return [0] * (len(of(0)) >= self.config.level0_runs) + big

    def compact_due(self) -> list[int]:
        """Compacts what is due; the levels compacted."""
        with self._lock:
            due = self.due()
            for level in due:
                self.compact(level)
            return due

    def rotate_log(self) -> int:
        """Deletes log files that runs have taken over, at once; the count of files."""
        with self._lock:
            return log.rotate(self.spark, self.log_path, self.store.manifest.checkpoint)

    def vacuum(self, seconds: float = 0) -> int:
        """Deletes files that ceased to count so long ago; how many."""
        with self._lock:
            return self.store.vacuum(seconds)

    def stats(self) -> dict[str, int]:
        with self._lock:
            self.refresh()
            m = self.store.manifest
            size = self.pending().agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0]
            return self._counts | {"flush_count": m.flushes, "compactions": m.compactions, "bytes_compacted": m.bytes_compacted, "sstable_count": len(m.runs), "memtable_size": size or 0}

    def stats_table(self) -> DataFrame:
        """(name, value)."""
        return self.spark.createDataFrame(list(self.stats().items()), "name string, value long")

    def stats_json(self) -> str:
        return as_json(self.stats_table()).first()[0]

    def run_table(self) -> DataFrame:
        """(level, run_id, entries, bytes, smallest, largest) of the listed runs."""
        lines = [(x[0], x[1], x[4], x[5], bytearray.fromhex(x[2]), bytearray.fromhex(x[3])) for x in self.store.manifest.runs]
        return self.spark.createDataFrame(lines, "level int, run_id long, entries long, bytes long, smallest binary, largest binary")

    def close(self) -> None:
        """Flushes what this store has written; one that only read leaves the writer alone."""
        if self.writing:
            self.flush()


class Upkeep:
    """Flushes and compacts what is due, every so many seconds, in a thread of its own. An error ends it, and stop() raises it."""

    def __init__(self, store: Store, seconds: float = 0.2) -> None:
        self.store, self.seconds, self.rounds = store, seconds, 0
        self._ended, self._error = threading.Event(), None
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        try:
            while not self._ended.wait(self.seconds):
                self.store.flush(force=False)
                self.store.compact_due()
                self.rounds += 1
        except Exception as e:
            self._error = e

    def start(self) -> Upkeep:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._ended.set()
        self._thread.join()
        if self._error is not None:
            raise self._error
