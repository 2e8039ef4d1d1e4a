"""The registered queries of the key-value engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.scalar import LOG_RECORD, LOG_RECORD_COMPACT, RUN_RECORD, RUN_RECORD_COMPACT, formatted_key, rank_percentiles, record_size, varint_size
from siltbed.config import Config
from siltbed.engine import Store, Upkeep
from siltbed.operators import compact, index, reads, resolve, stats
from siltbed.plans import load
from siltbed.plans.fixtures import OPS_SQL, count, operations, runs
from siltbed.sources import log
from siltbed.sources.folders import new_folder, written
from siltbed.sources.runs import RunStore
from siltbed.streaming.flush import latest_stream, log_stream, streamed_runs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = f"with {OPS_SQL.strip()}{sql}" if sql.lstrip().startswith(",") else f"with {OPS_SQL.strip()}\n{sql}"
        return f

    return keep


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.entries(operations(spark, sf_dir))


FIRST, LAST = "u00003", "u00011:k99"


@_query("q01_operation_log", "select seq, key, op, value from ops")
def q01(spark, sf_dir):
    return operations(spark, sf_dir).select("seq", "key", "op", "value")


@_query("q02_replay_latest", "select key, value, tombstone, seq from last")
def q02(spark, sf_dir):
    return resolve.latest(_entries(spark, sf_dir))


@_query("q03_replay_after_checkpoint", "select * from entry, total where seq > n // 2 qualify row_number() over (partition by key order by seq desc) = 1".replace("*", "key, value, tombstone, seq"))
def q03(spark, sf_dir):
    half = count(spark, sf_dir) // 2
    return resolve.latest(_entries(spark, sf_dir).where(F.col("seq") > half))


@_query(
    "q04_get",
    """, probe as (select min(key) as key from live union all select min(key) from last where tombstone union all select 'u99999:k00')
select probe.key, live.key is not null as found, live.value from probe left join live on probe.key = live.key""",
)
def q04(spark, sf_dir):
    versions = _entries(spark, sf_dir)
    first = resolve.latest(versions.select("key", "tombstone", "seq")).groupBy("tombstone").agg(F.min("key").alias("key")).collect()  # two rows
    probes = [r.key for r in first] + ["u99999:k00"]
    # Three keys in one read: a point read for each would scan the log three times.
    return reads.get_many(versions, spark.createDataFrame([(k,) for k in probes], "key string"))


_PROBE_SQL = """, probe as (select distinct key from ops where seq % 7 = 0 union select 'x' || key from ops where seq % 13 = 0)
"""


def _probes(spark, sf_dir):
    own, absent = F.when(F.col("seq") % 7 == 0, F.col("key")), F.when(F.col("seq") % 13 == 0, F.concat(F.lit("x"), "key"))
    return operations(spark, sf_dir).where("seq % 7 = 0 or seq % 13 = 0").select(F.explode(F.array_compact(F.array(own, absent))).alias("key")).distinct()


@_query("q05_batch_get", _PROBE_SQL + "select probe.key, live.key is not null as found, live.value from probe left join live on probe.key = live.key")
def q05(spark, sf_dir):
    return reads.get_many(_entries(spark, sf_dir), _probes(spark, sf_dir))


@_query(
    "q06_absent_keys",
    _PROBE_SQL + "select count(*) as n_probes, count(*) filter (where key not in (select key from ops)) as n_absent, 100.0 * count(*) filter (where key not in (select key from ops)) / count(*) as pct_rejected from probe".replace("100.0", "cast(100 as double)"),
)
def q06(spark, sf_dir):
    probes = _probes(spark, sf_dir)
    absent = reads.absent(_entries(spark, sf_dir), probes).agg(F.count("*").alias("n_absent"))
    both = probes.agg(F.count("*").alias("n_probes")).join(F.broadcast(absent))
    return both.select("n_probes", "n_absent", (F.lit(100.0) * F.col("n_absent") / F.col("n_probes")).alias("pct_rejected"))


@_query("q07_range_scan", f"select key, value, seq from live where key between '{FIRST}' and '{LAST}'")
def q07(spark, sf_dir):
    return reads.scan(_entries(spark, sf_dir), FIRST, LAST)


@_query("q08_scan_limit", f"select key, value, seq from live where key >= '{FIRST}' and key < 'u9' order by key limit 1000")
def q08(spark, sf_dir):
    return reads.scan(_entries(spark, sf_dir), FIRST, "u9", end_exclusive=True, limit=1000)


@_query("q09_latest_by_rank", "select key, value, tombstone, seq, run_id, level from run qualify row_number() over (partition by key order by seq desc, run_id desc) = 1")
def q09(spark, sf_dir):
    return resolve.latest(runs(spark, sf_dir), order=("seq", "run_id"))


@_query("q10_snapshot", "select key, value, tombstone, seq from last")
def q10(spark, sf_dir):
    return resolve.snapshot(_entries(spark, sf_dir))


@_query("q11_run_entries", "select key, value, tombstone, seq, run_id, level from run")
def q11(spark, sf_dir):
    return runs(spark, sf_dir)


@_query("q11b_run_scan", f"select key, value, tombstone, seq from run where run_id = 5 and key between '{FIRST}' and '{LAST}'")
def q11b(spark, sf_dir):
    one = runs(spark, sf_dir).where("run_id = 5")
    return reads.between(one, FIRST, LAST).select("key", "value", "tombstone", "seq").orderBy("key")


@_query("q12_compact_upper", "select key, value, tombstone, seq from run where level in (0, 1) qualify row_number() over (partition by key order by seq desc) = 1")
def q12(spark, sf_dir):
    return compact.merged(runs(spark, sf_dir), [0, 1], bottom=False)


@_query("q12b_compact_bottom", "select * from (select key, value, tombstone, seq from run where level in (1, 2) qualify row_number() over (partition by key order by seq desc) = 1) where not tombstone")
def q12b(spark, sf_dir):
    return compact.merged(runs(spark, sf_dir), [1, 2], bottom=True)


@_query(
    "q12c_state_after_compaction",
    "select key, value, seq from live",
)
def q12c(spark, sf_dir):
    """The live state over levels 0 and 1 compacted and level 2 as it was: what it was before."""
    all_runs = runs(spark, sf_dir)
    upper = compact.merged(all_runs, [0, 1], bottom=False)
    return resolve.live(resolve.merge([upper, all_runs.where("level = 2").select("key", "value", "tombstone", "seq")]))


_BYTES = "cast(strlen(key) + coalesce(strlen(cast(value as varchar)), 0) as bigint)"


def _sized_runs(spark, sf_dir):
    """Runs with the value as a whole number's digits: the text of a double differs between engines."""
    return runs(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 100).cast("long").cast("string"))


_SIZED = """, sized as (select key, cast(cast(floor(value * 100) as bigint) as varchar) as value, tombstone, seq, run_id, level from run)
"""


@_query(
    "q13_level_state",
    _SIZED + f"""select level, count(distinct run_id) as files, cast(sum({_BYTES} + {RUN_RECORD}) as bigint) as bytes,
  case level when 0 then count(distinct run_id) >= 4 when 1 then sum({_BYTES} + {RUN_RECORD}) > 10485760 else false end as due from sized group by level""",
)
def q13(spark, sf_dir):
    return compact.level_state(_sized_runs(spark, sf_dir))


@_query("q13b_read_order", "select distinct level, run_id from run")
def q13b(spark, sf_dir):
    return compact.read_order(runs(spark, sf_dir))


@_query(
    "q14_run_metadata",
    _SIZED + f"""select run_id, level, count(*) as num_entries, count(*) filter (where tombstone) as num_tombstones, min(key) as smallest, max(key) as largest, min(seq) as min_seq, max(seq) as max_seq,
  cast(sum({_BYTES} + {RUN_RECORD}) as bigint) as file_size from sized group by run_id, level""",
)
def q14(spark, sf_dir):
    return index.run_metadata(_sized_runs(spark, sf_dir))


@_query(
    "q15_candidate_runs",
    _PROBE_SQL + """, meta as (select run_id, level, min(key) as lo, max(key) as hi from run group by run_id, level)
select probe.key, run_id, level from probe join meta on probe.key between lo and hi""",
)
def q15(spark, sf_dir):
    return index.candidate_runs(index.run_bounds(runs(spark, sf_dir)), _probes(spark, sf_dir))


@_query(
    "q16_answering_run",
    """, meta as (select run_id, min(key) as lo, max(key) as hi from run group by run_id)
, answer as (select * from run qualify row_number() over (partition by key order by seq desc, run_id desc) = 1)
select a.key, a.run_id, a.level, a.tombstone as deleted, count(*) as runs_probed from answer a join meta m on m.run_id >= a.run_id and a.key between lo and hi group by all""",
)
def q16(spark, sf_dir):
    return index.answering_run(runs(spark, sf_dir))


_INDEX = _SIZED + f""", placed as (
  select run_id, key, row_number() over w as i, cast(coalesce(sum({_BYTES} + {RUN_RECORD}) over (partition by run_id order by key rows between unbounded preceding and 1 preceding), 0) + 8 as bigint) as "offset"
  from sized window w as (partition by run_id order by key)
), idx as (select run_id, key, "offset" from placed where (i - 1) % 16 = 0)
"""


@_query("q17_sparse_index", _INDEX + 'select run_id, key, "offset" from idx')
def q17(spark, sf_dir):
    return index.sparse_index(_sized_runs(spark, sf_dir))


@_query(
    "q18_index_seek",
    _INDEX + """, want as (select distinct run_id, key from run where seq % 5 = 0 union select run_id, 'a' from run)
select want.run_id, want.key, coalesce(max_by(idx."offset", idx.key), -1) as "offset" from want left join idx on want.run_id = idx.run_id and idx.key <= want.key group by want.run_id, want.key""",
)
def q18(spark, sf_dir):
    r = _sized_runs(spark, sf_dir)
    probes = r.where("seq % 5 = 0").select("run_id", "key").union(r.select("run_id", F.lit("a").alias("key")).distinct())
    return index.seek(index.sparse_index(r), probes)


def _requests(spark, sf_dir):
    """The log as engine operations: purchases count as reads, the newest tenth is still in memory."""
    n = count(spark, sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "GET").when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").join(operations(spark, sf_dir).select("seq", "key"), F.col("event_id") == F.col("seq"))
    return ev.select(
        kind.alias("kind"),
        "key",
        F.when(kind == "PUT", F.floor(F.col("value") * 100).cast("long").cast("string")).alias("value"),
        F.when(F.col("user_id") % 3 == 0, "memory").when(F.col("user_id") % 3 == 1, "run").alias("tier"),
        (F.col("user_id") % 4).alias("rejected"),
        (F.col("seq") >= n - n // 10).alias("in_memory"),
    )


_REQUESTS = """, req as (
  select case event_type when 'purchase' then 'GET' when 'error' then 'DELETE' else 'PUT' end as kind, o.key,
    case when event_type not in ('purchase', 'error') then cast(cast(floor(e.value * 100) as bigint) as varchar) end as value,
    case user_id % 3 when 0 then 'memory' when 1 then 'run' end as tier, user_id % 4 as rejected, o.seq >= n - n // 10 as in_memory
  from events e join ops o on e.event_id = o.seq, total
), size as (select *, strlen(key) + coalesce(strlen(value), 0) as b from req)
, counters as (
  select unnest([
    struct_pack(name := 'writes', value := cast(count(*) filter (where kind = 'PUT') as bigint)),
    struct_pack(name := 'reads', value := cast(count(*) filter (where kind = 'GET') as bigint)),
    struct_pack(name := 'deletes', value := cast(count(*) filter (where kind = 'DELETE') as bigint)),
    struct_pack(name := 'mem_hits', value := cast(count(*) filter (where kind = 'GET' and tier = 'memory') as bigint)),
    struct_pack(name := 'sst_hits', value := cast(count(*) filter (where kind = 'GET' and tier = 'run') as bigint)),
    struct_pack(name := 'bloom_misses', value := cast(coalesce(sum(rejected) filter (where kind = 'GET'), 0) as bigint)),
    struct_pack(name := 'bytes_written', value := cast(coalesce(sum(b) filter (where kind = 'PUT'), 0) as bigint)),
    struct_pack(name := 'memtable_size', value := cast(coalesce(sum(b) filter (where in_memory and kind <> 'GET'), 0) as bigint)),
    struct_pack(name := 'flush_count', value := (select count(distinct run_id) from run)),
    struct_pack(name := 'bytes_compacted', value := cast(0 as bigint)),
    struct_pack(name := 'sstable_count', value := (select count(distinct run_id) from run))
  ]) as c from size
), engine as (select c.name as name, c.value as value from counters)
"""


@_query("q19_engine_stats", _REQUESTS + "select name, value from engine")
def q19(spark, sf_dir):
    """Counters of a log of requests; the store's own are in q36."""
    made = runs(spark, sf_dir).agg(F.countDistinct("run_id").alias("n")).first().n
    return stats.engine_stats(_requests(spark, sf_dir), sstable_count=made, flush_count=made)


@_query(
    "q19b_server_stats",
    _REQUESTS + """, call as (select user_id, event_type, value, props from events)
, server as (select unnest([
    struct_pack(name := 'total_connections', value := cast(count(distinct user_id) as bigint)),
    struct_pack(name := 'active_connections', value := cast(count(distinct user_id) filter (where event_type = 'view') as bigint)),
    struct_pack(name := 'total_requests', value := cast(count(*) as bigint)),
    struct_pack(name := 'errors', value := cast(count(*) filter (where event_type = 'error') as bigint)),
    struct_pack(name := 'bytes_read', value := cast(coalesce(sum(strlen(props)), 0) as bigint)),
    struct_pack(name := 'bytes_written', value := cast(coalesce(sum(strlen(event_type)), 0) as bigint))
  ]) as c from call)
select c.name as name, c.value as value from server union all select 'engine_' || name, value from engine""",
)
def q19b(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    calls = ev.select(F.col("user_id").alias("connection"), (F.col("event_type") == "view").alias("open"), (F.col("event_type") != "error").alias("ok"), F.octet_length("props").alias("bytes_in"), F.octet_length("event_type").alias("bytes_out"))
    return stats.server_stats(calls, q19(spark, sf_dir))


@_query("q19c_save_rate", "select user_id, count(*) filter (where event_type = 'view') as saved, count(*) filter (where event_type = 'click') as read,\n  case when count(*) filter (where event_type in ('view', 'click')) = 0 then 0 else cast(count(*) filter (where event_type = 'view') as double) / count(*) filter (where event_type in ('view', 'click')) end as rate from events group by user_id")
def q19c(spark, sf_dir):
    one = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("saved"), F.count_if(F.col("event_type") == "click").alias("read"))
    return one.withColumn("rate", stats.save_rate(F.col("saved"), F.col("read")))


@_query(
    "q20_ticks",
    """, tick as (select date_trunc('hour', ts) as tick, count(*) filter (where op = 'PUT') as puts, count(*) filter (where op = 'DELETE') as deletes from ops group by 1)
select epoch_us(tick) as tick, puts, deletes, cast(sum(puts) over (order by tick) as bigint) as total_puts, cast(sum(deletes) over (order by tick) as bigint) as total_deletes,
  puts + deletes - coalesce(lag(puts + deletes) over (order by tick), 0) as change from tick""",
)
def q20(spark, sf_dir):
    return stats.ticks(operations(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").withColumn("tick", F.unix_micros("tick"))


@_query("q20b_throughput", "select count(*) as ops, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) as ops_per_second from ops")
def q20b(spark, sf_dir):
    return stats.throughput(operations(spark, sf_dir))


_SHARES = [("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999), ("max", 1.0)]


@_query(
    "q21_rank_percentiles",
    f""", lat as (select cast(floor(value * 1000) as bigint) as v, row_number() over (order by value) - 1 as r, count(*) over () as n from events where value is not null)
, share as (select unnest({[x for x, _ in _SHARES]!r}) as name, unnest({[x for _, x in _SHARES]!r}) as p)
select name, v as value from share, lat where r = least(cast(floor(n * cast(p as double)) as bigint), n - 1)""",
)
def q21(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("value") * 1000).cast("long").alias("latency"))
    return rank_percentiles(ev, "latency", _SHARES)


@_query("q22_valid_prefix", "select seq, op, key from ops, total where seq < n * 3 // 5")
def q22(spark, sf_dir):
    """A log in which one record in the middle and one near the end lost a byte."""
    n = count(spark, sf_dir)
    records = log.with_crc(operations(spark, sf_dir).withColumn("value", F.col("value").cast("string")))
    hurt = F.col("seq").isin(n * 3 // 5, n - 2)
    torn = records.withColumn("value", F.when(hurt, F.lit(b"x")).otherwise(F.col("value")))
    return log.replay(torn).select("seq", "op", F.col("key").cast("string").alias("key"))


@_query(
    "q23_recovery",
    """, got as (select key, case when seq % 77 = 0 then value + 1 else value end as value from live where seq % 50 <> 0 union all select 'zz', 0)
select count(*) filter (where l.key is not null and g.key is not null and l.value is not distinct from g.value) as recovered, count(*) filter (where g.key is null) as missing,
  count(*) filter (where l.key is not null and g.key is not null and l.value is distinct from g.value) as wrong, count(*) filter (where l.key is null) as unexpected
from live l full join got g on l.key = g.key""",
)
def q23(spark, sf_dir):
    live = resolve.live(resolve.latest(_entries(spark, sf_dir)))
    got = live.where("seq % 50 <> 0").select("key", F.when(F.col("seq") % 77 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return resolve.recovery(live.select("key", "value"), got.unionByName(spark.createDataFrame([("zz", 0.0)], "key string, value double")))


@_query(
    "q24_snapshot_difference",
    """, early as (select * from (select * from entry, total where seq <= n // 2 qualify row_number() over (partition by key order by seq desc) = 1) where not tombstone)
select coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as change, a.value as old_value, b.value as new_value
from early a full join live b on a.key = b.key where a.seq is distinct from b.seq""",
)
def q24(spark, sf_dir):
    versions = _entries(spark, sf_dir)
    early = resolve.live(resolve.latest(versions.where(F.col("seq") <= count(spark, sf_dir) // 2)))
    return resolve.difference(early, resolve.live(resolve.latest(versions)))


@_query(
    "q25_record_sizes",
    f""", r as (select strlen(key) as k, strlen(coalesce(cast(cast(floor(value * 100) as bigint) as varchar), '')) as v, seq, op from ops)
select op, cast(sum(k + v + {LOG_RECORD}) as bigint) as log_bytes, cast(sum(k + v + {LOG_RECORD_COMPACT}) as bigint) as compact_log_bytes, cast(sum(k + v + {RUN_RECORD}) as bigint) as run_bytes,
  cast(sum(k + v + {RUN_RECORD_COMPACT}) as bigint) as compact_run_bytes, cast(sum(case when seq < 128 then 1 when seq < 16384 then 2 when seq < 2097152 then 3 else 4 end) as bigint) as varint_bytes from r group by op""",
)
def q25(spark, sf_dir):
    r = operations(spark, sf_dir).select("op", "seq", "key", F.floor(F.col("value") * 100).cast("long").cast("string").alias("value"))
    size = lambda n, name: F.sum(record_size(F.col("key"), F.col("value"), n)).alias(name)
    return r.groupBy("op").agg(size(LOG_RECORD, "log_bytes"), size(LOG_RECORD_COMPACT, "compact_log_bytes"), size(RUN_RECORD, "run_bytes"), size(RUN_RECORD_COMPACT, "compact_run_bytes"), F.sum(varint_size(F.col("seq"))).cast("long").alias("varint_bytes"))


@_query(
    "q26_bloom",
    "select run_id, count(*) as n_keys, count(*) as n_found, true as rejects_90_percent from run group by run_id",
)
def q26(spark, sf_dir):
    """Of each run's filter: all its keys are found, and of keys that no run has at least nine in ten are rejected."""
    r = written(runs(spark, sf_dir).select("run_id", "level", "key"), "keys")
    bloom, bounds = index.bloom_build(r), index.run_bounds(r)
    own = index.bloom_own(bloom, r).groupBy("run_id").agg(F.count("*").alias("n_keys"), F.count_if("maybe").alias("n_found"))
    other = r.select(F.concat("key", F.lit("-absent")).alias("key"))  # mostly within the bounds
    spared = index.bloom_probe(bloom, other, bounds).groupBy("run_id").agg((F.count_if(~F.col("maybe")) >= 0.9 * F.count("*")).alias("rejects_90_percent"))
    return own.join(spared, "run_id")


@_query("q27_stream_flush", "select key, value, seq from live")
def q27(spark, sf_dir):
    """The log as a stream of five files, each flushed to a run; the live state over the runs."""
    folder = new_folder(spark, "stream")
    records = operations(spark, sf_dir).select("op", "seq", "key", "value")
    records.repartitionByRange(5, "seq").write.parquet(f"{folder}/log")
    made = streamed_runs(spark, f"{folder}/log", "op string, seq long, key string, value double", folder)
    return resolve.live(resolve.latest(made.select("key", "value", "tombstone", "seq")))


@_query("q28_stream_state", "select key, value, tombstone, seq from last")
def q28(spark, sf_dir):
    """The latest version of each key as streaming state, written once the stream has caught up."""
    folder = new_folder(spark, "state")
    operations(spark, sf_dir).select("op", "seq", "key", "value").repartitionByRange(3, "seq").write.parquet(f"{folder}/log")
    state = latest_stream(log_stream(spark, f"{folder}/log", "op string, seq long, key string, value double"))
    save = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/state")
    state.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/state").select("key", "value", "tombstone", "seq")


@_query("q29_run_files", "select key, cast(cast(floor(value * 100) as bigint) as varchar) as value, tombstone, seq, run_id, level from run where level = 1")
def q29(spark, sf_dir):
    """All runs written as sorted files with Bloom filters, and the runs of level 1 read back through the manifest."""
    store = RunStore(spark, new_folder(spark, "runs"))
    made = _sized_runs(spark, sf_dir)
    for r in made.select("level", "run_id").distinct().collect():  # ten
        one = made.where((F.col("run_id") == r.run_id)).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "tombstone", "seq")
        store.manifest.runs.append(store.write(one, r.level, r.run_id, 10_000))
    store.save()
    back = RunStore(spark, store.folder).read(levels=[1])
    return back.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone", "seq", "run_id", "level")


@_query(
    "q30_line_items_latest",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1""",
)
def q30(spark, sf_dir):
    """Overwrites by volume: the latest line of each order and line number, every column deciding ties."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    order = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return resolve.latest(items, keys=("l_orderkey", "l_linenumber"), order=order).drop("l_shipdate")


@_query("q04b_raw_get", """select * from last where key = (select min(key) from last where tombstone)""")
def q04b(spark, sf_dir):
    """The raw lookup finds a tombstone."""
    versions = _entries(spark, sf_dir)
    key = resolve.latest(versions).where("tombstone").agg(F.min("key")).first()[0]
    return reads.raw_get(versions, key)


@_query(
    "q10b_memory_size",
    """, tail as (select key, value, op from ops, total where seq >= n - n // 10 qualify row_number() over (partition by key order by seq desc) = 1)
select count(*) as n_entries, count(*) filter (where op = 'DELETE') as n_tombstones, cast(sum(strlen(key) + case when value is null then 0 else 8 end) as bigint) as n_bytes from tail""",
)
def q10b(spark, sf_dir):
    """What is not flushed yet: entries with tombstones, and bytes of keys and values."""
    n = count(spark, sf_dir)
    tail = resolve.latest(_entries(spark, sf_dir).where(F.col("seq") >= n - n // 10))
    size = F.octet_length("key") + F.when(F.col("value").isNull(), 0).otherwise(8)
    return tail.agg(F.count("*").alias("n_entries"), F.count_if("tombstone").alias("n_tombstones"), F.sum(size).alias("n_bytes"))


_LOAD = """, load as (
  select id, x % 100 < 40 as write, x % 2000000 + 1000 as ns, x % 997 <> 0 as ok from (select seq as id, (seq + 1) * 48271 % 2147483647 as x from ops)
), good as (select ns, row_number() over (order by ns) - 1 as r, count(*) over () as n from load where ok)
, share as (select unnest(['p50', 'p95', 'p99', 'p999', 'max']) as name, unnest([0.5, 0.95, 0.99, 0.999, 1.0]) as p)
select 'writes' as name, count(*) filter (where ok and write) as value from load union all select 'reads', count(*) filter (where ok and not write) from load
union all select 'errors', count(*) filter (where not ok) from load
union all select name, ns from share, good where r = least(cast(floor(n * cast(p as double)) as bigint), n - 1)"""


@_query("q31_load_report", _LOAD)
def q31(spark, sf_dir):
    """As many operations as the log has, at four writes in ten, and their report."""
    return load.report(load.operations(spark, count(spark, sf_dir)))


# Through a store


def _told(spark, sf_dir):
    """The log with values as a whole number's digits: (op, seq, key, value), strings."""
    return operations(spark, sf_dir).select("op", "seq", "key", F.floor(F.col("value") * 100).cast("long").cast("string").alias("value"))


def _quarters(spark, sf_dir):
    n = count(spark, sf_dir)
    log_ = _told(spark, sf_dir)
    return [log_.where(F.floor(F.col("seq") * 4 / n) == q) for q in range(4)]


_stores: dict[tuple[str, str], Store] = {}


def _store(spark, sf_dir) -> Store:
    """The log's quarters in a store that queries of a session share: three flushed, which compacts them into one run, the last in its log."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = Store(spark, new_folder(spark, "store"), Config(level0_runs=3, in_order=True))
        for q, part in enumerate(_quarters(spark, sf_dir)):
            store.ingest(part)
            if q < 3:
                store.flush()
                store.compact_due()
        _stores[key] = store
    return _stores[key]


def _strings(df):
    return df.withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))


_TOLD = """, told as (select key, case when op = 'PUT' then cast(cast(floor(value * 100) as bigint) as varchar) end as value, op, seq, cast(floor(seq * 4 / n) as bigint) as quarter from ops, total)
, newest as (select * from told qualify row_number() over (partition by key order by seq desc) = 1)
"""


@_query("q32_store_scan", _TOLD + "select key, value, seq from newest where op = 'PUT'")
def q32(spark, sf_dir):
    """Puts and deletes by batch, flushes and a compaction, then a scan of all."""
    return _strings(_store(spark, sf_dir).scan())


@_query("q32b_store_snapshot", _TOLD + "select key, value, op = 'DELETE' as tombstone, seq from newest where op = 'PUT' or quarter = 3")
def q32b(spark, sf_dir):
    """Tombstones that the compaction had nothing to hide below are gone, those in the log are not."""
    return _strings(_store(spark, sf_dir).snapshot())


@_query("q33_store_range", _TOLD + f"select key, value, seq from newest where op = 'PUT' and key >= '{FIRST}' and key < '{LAST}' order by key limit 100")
def q33(spark, sf_dir):
    return _strings(_store(spark, sf_dir).scan(FIRST.encode(), LAST.encode(), end_exclusive=True, limit=100))


@_query("q34_store_batch_get", _TOLD + _PROBE_SQL + "select probe.key, newest.key is not null as found, newest.value from probe left join newest on probe.key = newest.key and newest.op = 'PUT'")
def q34(spark, sf_dir):
    return _strings(_store(spark, sf_dir).get_many(_probes(spark, sf_dir)))


_POINTS = """, point as (select 'in the log' as name, min(key) as key from newest where quarter = 3 and op = 'PUT' union all select 'in a run', min(key) from newest where quarter < 3 and op = 'PUT'
  union all select 'deleted', min(key) from newest where op = 'DELETE' union all select 'absent', 'u00005:none' union all select 'beyond', 'zz')
"""


def _points(spark, sf_dir):
    """(name, key) of point reads: in the log, in a run, deleted, absent but within bounds, and beyond them."""
    n = count(spark, sf_dir)
    late = F.floor(F.col("seq") * 4 / n) == 3
    gone = F.col("op") == "DELETE"
    least = lambda holds: F.min(F.when(holds, F.col("key")))
    found = resolve.latest(_told(spark, sf_dir).select("key", "seq", "op")).agg(least(late & ~gone), least(~late & ~gone), least(gone)).first()
    return [*zip(("in the log", "in a run", "deleted"), found, strict=True), ("absent", "u00005:none"), ("beyond", "zz")]


@_query("q35_store_get", _TOLD + _POINTS + "select name, point.key, newest.value from point left join newest on point.key = newest.key and newest.op = 'PUT'")
def q35(spark, sf_dir):
    store = Store(spark, _store(spark, sf_dir).store.folder)
    read = lambda key: (lambda v: None if v is None else v.decode())(store.get(key.encode()))
    return spark.createDataFrame([(name, key, read(key)) for name, key in _points(spark, sf_dir)], "name string, key string, value string")


_STORE_STATS = _TOLD + _POINTS + """, upper as (select * from told where quarter < 3 qualify row_number() over (partition by key order by seq desc) = 1)
, ends as (select min(key) as lo, max(key) as hi from upper where op = 'PUT')
, entry_ as (select *, strlen(key) + coalesce(strlen(value), 0) as b from told)
, flushed as (select * from entry_ where quarter < 3 qualify row_number() over (partition by quarter, key order by seq desc) = 1)
, stat as (select unnest([
  struct_pack(name := 'writes', value := (select count(*) from entry_ where op = 'PUT')),
  struct_pack(name := 'deletes', value := (select count(*) from entry_ where op = 'DELETE')),
  struct_pack(name := 'bytes_written', value := (select cast(sum(b) as bigint) from entry_ where op = 'PUT')),
  struct_pack(name := 'memtable_size', value := (select cast(sum(b) as bigint) from entry_ where quarter = 3)),
  struct_pack(name := 'bytes_compacted', value := (select cast(sum(b + 21) as bigint) from flushed)),
  struct_pack(name := 'flush_count', value := 3), struct_pack(name := 'compactions', value := 1), struct_pack(name := 'sstable_count', value := 1),
  struct_pack(name := 'reads', value := 5), struct_pack(name := 'mem_hits', value := 1), struct_pack(name := 'sst_hits', value := 1), struct_pack(name := 'bloom_misses', value := (select count(*) from point, ends where key not between lo and hi))
]) as c)
"""


@_query("q36_store_stats", _STORE_STATS + "select c.name as name, cast(c.value as bigint) as value from stat")
def q36(spark, sf_dir):
    """The counters of a store that wrote the log, and of another that opened its folder and did the five point reads."""
    writer = _store(spark, sf_dir)
    reader = Store(spark, writer.store.folder)
    for _, key in _points(spark, sf_dir):
        reader.get(key.encode())
    wrote = {k: v for k, v in writer.stats().items() if k in ("writes", "deletes", "bytes_written")}
    return spark.createDataFrame(list((reader.stats() | wrote).items()), "name string, value long")


@_query("q36b_stats_json", _REQUESTS + "select '{' || string_agg('\"' || name || '\":' || value, ',' order by name) || '}' as stats from engine")
def q36b(spark, sf_dir):
    return stats.as_json(q19(spark, sf_dir))


@_query(
    "q37_store_runs",
    _TOLD + """, upper as (select * from told where quarter < 3 qualify row_number() over (partition by key order by seq desc) = 1)
select 1 as level, count(*) as entries, cast(sum(strlen(key) + strlen(value) + 21) as bigint) as bytes, min(key) as smallest, max(key) as largest from upper where op = 'PUT'""",
)
def q37(spark, sf_dir):
    """The manifest: the one run that the compaction left, without tombstones, as no level is below it."""
    return _store(spark, sf_dir).run_table().select("level", "entries", "bytes", F.col("smallest").cast("string").alias("smallest"), F.col("largest").cast("string").alias("largest"))


@_query("q38_recovery_after_bad_records", _TOLD + "select key, value, seq from newest where op = 'PUT' union all select 'zz:after', 'x', 9000000000000000001")
def q38(spark, sf_dir):
    """Bad records at the checkpoint and at the log's end: what is written after them counts, in the same session and after reopening; what lies behind the second doesn't."""
    first, second, third, fourth = _quarters(spark, sf_dir)
    store = Store(spark, new_folder(spark, "torn"))
    store.ingest(first.unionByName(second))
    store.flush()
    store.ingest(third)
    m = store.store.manifest
    torn = [("PUT", 1, "zz:below", "x", 0, m.checkpoint, m.epochs[-1][0]), ("PUT", 2, "zz:torn", "x", 0, m.next_pos, m.epochs[-1][0])]
    schema = "op string, seq long, key string, value string, crc long, pos long, epoch long"
    as_bytes = lambda df: df.withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary")})
    as_bytes(spark.createDataFrame(torn, schema)).write.mode("append").parquet(store.log_path)
    log.append(as_bytes(spark.createDataFrame([("PUT", 3, "zz:behind", "x", 0, m.next_pos + 1, m.epochs[-1][0])], schema).drop("crc")), store.log_path)
    store.ingest(fourth)
    store.ingest(spark.createDataFrame([("PUT", 9000000000000000001, "zz:after", "x")], "op string, seq long, key string, value string"))
    if store.get(b"zz:after") != b"x":
        raise AssertionError("a write after a bad record is not visible")
    return _strings(Store(spark, store.store.folder).scan())


@_query("q39_late_records", _TOLD + "select key, value, seq from newest where op = 'PUT'")
def q39(spark, sf_dir):
    """The quarters of the log in the wrong order, the second twice, each flushed: records keep their seq, so late ones are hidden."""
    first, second, third, fourth = _quarters(spark, sf_dir)
    store = Store(spark, new_folder(spark, "late"), Config(level0_runs=2))
    for part in (third, second, fourth, first, second):
        store.ingest(part)
        store.flush()
        store.compact_due()
    return _strings(store.scan())


@_query("q40_reader_snapshot", _TOLD + "select key, value, seq from (select * from told where quarter < 2 qualify row_number() over (partition by key order by seq desc) = 1) where op = 'PUT'")
def q40(spark, sf_dir):
    """A scan made before further writes, a flush and a compaction, and read after them."""
    first, second, third, _ = _quarters(spark, sf_dir)
    store = Store(spark, new_folder(spark, "snapshot"), Config(level0_runs=2))
    store.ingest(first)
    store.flush()
    store.ingest(second)
    seen = store.scan()
    store.ingest(third)
    store.flush()
    store.compact_due()
    return _strings(seen)


@_query(
    "q41_flush_threshold",
    _TOLD + """, half as (select (seq * 8) // n as eighth, cast(sum(strlen(key) + coalesce(strlen(value), 0) + 21) as bigint) as bytes from told, total group by 1)
, recursive_ as (select eighth, bytes, sum(bytes) over (order by eighth) as upto, cast(avg(bytes) over () * 1.5 as bigint) as least from half)
select eighth, bytes, eighth % 2 = 1 as flushed from recursive_""",
)
def q41(spark, sf_dir):
    """Eighths of the log with a threshold of one and a half: every other write flushes."""
    n = count(spark, sf_dir)
    each = _told(spark, sf_dir).withColumn("eighth", F.floor(F.col("seq") * 8 / n))
    size = F.sum(record_size(F.col("key"), F.col("value"), LOG_RECORD)).alias("bytes")
    sizes = sorted(map(tuple, each.groupBy("eighth").agg(size).collect()))  # eight rows
    store = Store(spark, new_folder(spark, "threshold"), Config(flush_bytes=int(sum(b for _, b in sizes) / len(sizes) * 1.5)))
    rows = []
    for eighth, b in sizes:
        store.ingest(each.where(F.col("eighth") == eighth).drop("eighth"))
        rows.append((eighth, b, store.flush(force=False)))
    return spark.createDataFrame(rows, "eighth long, bytes long, flushed boolean")


@_query("q42_upkeep", _TOLD + "select key, value, seq from newest where op = 'PUT'")
def q42(spark, sf_dir):
    """A thread flushes and compacts while the log comes in by quarters; the state is what it would be without."""
    store = Store(spark, new_folder(spark, "upkeep"), Config(level0_runs=2, flush_bytes=1))
    upkeep = Upkeep(store, 0.05).start()
    for part in _quarters(spark, sf_dir):
        store.ingest(part)
    upkeep.stop()
    return _strings(store.scan())


@_query("q43_log_size", _TOLD + "select count(*) + 1 as records, cast(sum(strlen(key) + coalesce(strlen(value), 0) + 21) + 21 + 14 as bigint) as bytes, max(seq) as last_checkpoint from told")
def q43(spark, sf_dir):
    """A log with a checkpoint mark: its size, and where the mark is."""
    path = new_folder(spark, "log")
    log.append(_told(spark, sf_dir), path)
    log.checkpoint(spark, count(spark, sf_dir) - 1, path)
    records = log.read(spark, path)
    return log.size(records).withColumn("last_checkpoint", F.lit(log.last_checkpoint(records)))


@_query(
    "q44_file_swap",
    "select 1 as listed, 3 as retired, 3 as on_disk_before, 3 as removed, 1 as on_disk_after",
)
def q44(spark, sf_dir):
    """A compaction lists its output alone; inputs stay for their readers until a vacuum, and go then."""
    store = Store(spark, new_folder(spark, "swap"), Config(level0_runs=2))
    first, second, *_ = _quarters(spark, sf_dir)
    for part in (first, second):
        store.ingest(part)
        store.flush()
    store.rotate_log()
    store.store.manifest.garbage.clear()
    store.compact(0)
    at = lambda: sum(len(store.store.files.names(f"runs/{level}")) for level in store.store.files.names("runs"))
    before = at()
    retired = len(store.store.manifest.garbage)
    removed = store.vacuum()
    rows = [(len(store.store.manifest.runs), retired + 1, before, removed + 1, at())]
    return spark.createDataFrame(rows, "listed int, retired int, on_disk_before int, removed int, on_disk_after int")


@_query("q45_key_limits", "select seq, seq % 10 as length, seq % 10 between 1 and 4 as allowed from ops where seq < 200 union all select 1000, 4096, true union all select 1001, 4097, false".replace("seq % 10 between 1 and 4", "seq % 10 > 0"))
def q45(spark, sf_dir):
    """Which keys a store takes: 1 to 4,096 bytes."""
    store = Store(spark, new_folder(spark, "limits"))
    rows = []
    for seq, length in [(i, i % 10) for i in range(10)] + [(1000, 4096), (1001, 4097)]:
        try:
            store.put(b"k" * length, b"v")
            rows.append((length, True))
        except ValueError:
            rows.append((length, False))
    told = spark.createDataFrame(rows, "length long, allowed boolean")
    asked = operations(spark, sf_dir).where("seq < 200").select("seq", (F.col("seq") % 10).alias("length")).unionByName(spark.createDataFrame([(1000, 4096), (1001, 4097)], "seq long, length long"))
    return asked.join(told, "length").select("seq", "length", "allowed")


@_query("q46_byte_order", "select hex(b) as key from (select distinct unhex(md5(key)) as b from ops) order by b limit 500")
def q46(spark, sf_dir):
    """The first keys of any bytes: unsigned order, shorter prefix first."""
    keys = operations(spark, sf_dir).select(F.unhex(F.md5("key")).alias("key"), F.lit(None).cast("binary").alias("value"), F.lit(False).alias("tombstone"), "seq")
    return reads.scan(keys, limit=500).select(F.hex("key").alias("key"))


@_query("q47_key_format", "select seq, printf('key:%08d', seq) as key, printf('user:%016d', seq * 7) as wide from ops")
def q47(spark, sf_dir):
    return operations(spark, sf_dir).select("seq", formatted_key("key:", F.col("seq"), 8).alias("key"), formatted_key("user:", F.col("seq") * 7, 16).alias("wide"))


@_query(
    "q48_bloom_size",
    """, k as (select run_id, count(*) as n from run group by run_id), m as (select run_id, n, greatest(64, cast(ceil(ceil(-n * ln(0.01) / power(ln(2), 2)) / 64) as bigint) * 64) as bits from k)
select run_id, n as keys, bits, cast(greatest(1, least(20, round(bits / n * ln(2)))) as bigint) as hashes from m""",
)
def q48(spark, sf_dir):
    """Bits and hashes of a filter for each run at one false positive in a hundred."""
    rows = runs(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n")).collect()  # ten
    return spark.createDataFrame([(r.run_id, r.n, *index.bloom_size(r.n)) for r in rows], "run_id long, keys long, bits long, hashes long")


@_query("q49_load_through_store", "select 40 as requests, 100 as keys_a_request, count(*) filter (where (i + 1) * 48271 % 2147483647 % 100 < 40) as writes, count(*) filter (where (i + 1) * 48271 % 2147483647 % 100 >= 40) as reads, 0 as errors, true as ordered from (select unnest(range(40)) as i)")
def q49(spark, sf_dir):
    """Forty requests from four threads against a store, by their outcome; latencies are in order, whatever they are."""
    done = load.drive(Store(spark, new_folder(spark, "load")), 40)
    told = {r.name: r.value for r in load.report(done).collect()}
    ordered = told["p50"] <= told["p95"] <= told["p99"] <= told["p999"] <= told["max"]
    return spark.createDataFrame([(40, 100, told["writes"], told["reads"], told["errors"], ordered)], "requests int, keys_a_request int, writes long, reads long, errors long, ordered boolean")


def scanned(df: DataFrame) -> int:
    """Rows that came out of the files when df was read: its scans' metric."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan"):
            rows += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


@_query("q50_filter_skips", "select 20 as probes, 0 as read_with_filter, true as read_without, 0 as found from (select 1)")
def q50(spark, sf_dir):
    """Point reads of absent keys within a run's bounds: with the Bloom filter no row is read, with the filter switched off there are some."""
    store = RunStore(spark, new_folder(spark, "filter"))
    keys = operations(spark, sf_dir).select(F.col("key").cast("binary").alias("key")).distinct().select("key", F.lit(b"v").alias("value"), F.lit(False).alias("tombstone"), F.lit(1).cast("long").alias("seq"))
    # At a rate of one in a hundred, one of twenty probes is let through in every fifth log or so.
    store.manifest.runs.append(store.write(keys, 0, 0, 100_000, fpp=1e-6))
    absent = [bytearray(r.key + b"-") for r in keys.orderBy("key").limit(20).collect()]
    one = lambda key, on: store.read(**{"parquet.filter.bloom.enabled": on, "parquet.filter.columnindex.enabled": "false"}).where(F.col("key") == key)
    with_, without = (sum(scanned(one(k, on)) for k in absent) for on in ("true", "false"))
    found = sum(one(k, "true").count() for k in absent)
    return spark.createDataFrame([(20, with_, without > 0, found)], "probes int, read_with_filter int, read_without boolean, found int")


@_query("q51_ping", "select true as answers, 1 as rows from (select 1)")
def q51(spark, sf_dir):
    return spark.createDataFrame([(Store(spark, new_folder(spark, "ping")).ping(), 1)], "answers boolean, rows int")


@_query(
    "q52_lookup_each_line",
    """, state as (select o_orderkey as key, o_totalprice as value from orders qualify row_number() over (partition by o_orderkey order by o_orderdate desc, o_totalprice desc) = 1)
select l_orderkey % 1000 as bucket, count(*) as lookups, count(state.key) as found from lineitem left join state on l_orderkey = state.key group by 1""",
)
def q52(spark, sf_dir):
    """A lookup for every line item, repeated keys and all: found or not, by bucket of keys."""
    order = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), "o_orderdate", "o_totalprice")
    state = resolve.latest(order, order=("o_orderdate", "o_totalprice")).select("key", F.lit(1).alias("hit"))
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key"))
    return asked.join(state, "key", "left").groupBy((F.col("key") % 1000).alias("bucket")).agg(F.count("*").alias("lookups"), F.count("hit").alias("found"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live state by key: the log resolved and scanned from end to end."""
    return reads.scan(_entries(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
