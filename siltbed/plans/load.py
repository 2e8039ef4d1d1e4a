"""A mixed load: reads and writes of formatted keys, as a table or against a store, and its report."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.engine import Store
from siltbed.functions.scalar import formatted_key, rank_percentiles

#: A multiplicative step and a prime: plain arithmetic, so that any engine gives the same rows.
STEP, PRIME = 48_271, 2_147_483_647


def operations(spark: SparkSession, n: int, keys: int = 100_000, write_percent: int = 40, clients: int = 200) -> DataFrame:
    """(id, client, kind, key, latency_ns, ok) of n operations; nothing is drawn at random."""
    x = (F.col("id") + 1) * STEP % PRIME
    kind = F.when(x % 100 < write_percent, "WRITE").otherwise("READ")
    return spark.range(n).select(
        "id",
        (F.col("id") % clients).alias("client"),
        kind.alias("kind"),
        formatted_key("key:", F.floor(x / 100) % keys, 8).alias("key"),
        (x % 2_000_000 + 1000).alias("latency_ns"),
        (x % 997 != 0).alias("ok"),
    )


def drive(store: Store, requests: int, batch: int = 100, keys: int = 1_000, write_percent: int = 40, clients: int = 4) -> DataFrame:
    """Runs requests against a store from several threads: (id, client, kind, n, latency_ns, ok), a row for each request.

    All keys are there from the start. A request writes, or looks up, `batch` neighbouring keys; it is ok if it didn't fail and, of a read, if each
    key was found with a value that belongs to it. Latencies are measured around the call and the collection of what it returns.
    """
    name = lambda i: b"key:%08d" % (i % keys)
    store.put_many([(name(i), b"%s=start" % name(i)) for i in range(keys)])

    def one(i: int) -> tuple[int, int, str, int, int, bool]:
        x = (i + 1) * STEP % PRIME
        some = [name(x + k) for k in range(batch)]
        write = x % 100 < write_percent
        began = time.perf_counter_ns()
        try:
            if write:
                store.put_many([(k, b"%s=%d" % (k, i)) for k in some])
                ok = True
            else:
                found = store.get_many(store.spark.createDataFrame([(bytearray(k),) for k in some], "key binary")).collect()
                ok = len(found) == len(set(some)) and all(r.found and bytes(r.value).startswith(bytes(r.key) + b"=") for r in found)
        except Exception:
            ok = False
        return i, i % clients, "WRITE" if write else "READ", batch, time.perf_counter_ns() - began, ok

    with ThreadPoolExecutor(clients) as pool:
        rows = list(pool.map(one, range(requests)))
    return store.spark.createDataFrame(rows, "id long, client long, kind string, n long, latency_ns long, ok boolean")


def report(load: DataFrame) -> DataFrame:
    """(name, value): counts by kind, errors, and latency percentiles of what succeeded."""
    one = load.agg(F.count_if(F.col("ok") & (F.col("kind") == "WRITE")).alias("writes"), F.count_if(F.col("ok") & (F.col("kind") == "READ")).alias("reads"), F.count_if(~F.col("ok")).alias("errors"))
    rows = one.unpivot([], ["writes", "reads", "errors"], "name", "value")
    return rows.unionByName(rank_percentiles(load.where("ok"), "latency_ns", [("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999), ("max", 1.0)]))
