"""Merkle fixity audit of archive replicas.

A replica is a table of records (file, offset, record). Each record is hashed where it lies; leaves of a file's tree are ordered
offset ranges of `span` bytes, each the hash of what its records' digests of (offset, length, hash) add up to; a node is the hash of
its at most `fan` children, with their numbers, in order. Replicas are compared root by root; below a root that differs only
children of differing nodes are compared, level by level, until the records of differing ranges are left.

How it scales: record bytes are never shuffled, only digests, which are written once to the shared folder. Ranges are fixed by offset, so a
file of any length is spread over many leaves. A leaf is a sum of numbers, made by partial aggregation: no task holds its records, however many
claim one offset. Records without an offset are spread over `_LOOSE` leaves of negative number by their hash. An inner node has `fan` children. The driver learns
the largest offset, which gives the number of levels. Suspect nodes, not all nodes, drive the joins on the way down.

Cases: a null record is hashed as missing content (hash '-', length 0); a null file is file -1; records without an offset are compared by
their hash alone. Several records at one offset are compared as a bag: where one replica has just one record its hash is told, else 'bag:' with their number
and the digest of their sum. A range that only one replica has differs. Other columns are ignored; two empty tables agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.llm.shared import written

SPAN, FAN = 1 << 16, 16


#: Leaves of a file for records without an offset.
_LOOSE = 4096


def digest_records(records: DataFrame) -> DataFrame:
    """(file, offset, length, hash) of each record."""
    body = F.col("record").cast("binary")
    return records.select(
        F.coalesce(F.col("file").cast("long"), F.lit(-1).cast("long")).alias("file"),
        F.col("offset").cast("long").alias("offset"),
        F.coalesce(F.octet_length(body).cast("long"), F.lit(0).cast("long")).alias("length"),
        F.coalesce(F.sha2(body, 256), F.lit("-")).alias("hash"),
    )


def _part(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size).cast("long")


def _range(span: int) -> Column:
    """The leaf of a record."""
    loose = -1 - F.pmod(F.xxhash64("hash"), F.lit(_LOOSE))
    return F.coalesce(_part("offset", span), loose).cast("long").alias("node")


def _sums() -> list[Column]:
    """What stands for a bag of records: their number, and sums of the quarters of each record's SHA-256."""
    told = F.sha2(F.concat_ws(":", F.coalesce(F.col("offset").cast("string"), F.lit("-")), "length", "hash"), 256)
    quarter = lambda k: F.conv(F.substring(told, 16 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    return [F.count("*").alias("n"), *[F.sum(quarter(k)).alias(f"q{k}") for k in range(4)]]


def _summed() -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(x).cast("string") for x in ("n", "q0", "q1", "q2", "q3")]), 256)


def tree(digests: DataFrame, levels: int, span: int = SPAN, fan: int = FAN) -> list[DataFrame]:
    """Nodes (file, node, hash) by level, the leaves first, the roots last: node 0, and a negative one for records without an offset."""
    out = [digests.groupBy("file", _range(span)).agg(*_sums()).select("file", "node", _summed().alias("hash"))]
    for _ in range(levels - 1):
        listed = F.sort_array(F.collect_list(F.struct("node", "hash")))  # fan at most
        below = F.concat_ws(",", F.transform(listed, lambda x: F.concat_ws(":", x["node"], x["hash"])))
        out.append(out[-1].withColumn("up", _part("node", fan)).groupBy("file", F.col("up").alias("node")).agg(F.sha2(below, 256).alias("hash")))
    return [written(x, "merkle") for x in out]


def _levels(digests: list[DataFrame], span: int, fan: int) -> int:
    most = max([0, *(d.agg(F.max("offset")).first()[0] or 0 for d in digests)]) // span
    levels = 1
    while most:
        most //= fan
        levels += 1
    return levels


def audit(a: DataFrame, b: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(file, offset, length_a, length_b, hash_a, hash_b, status: corrupt, missing_a or missing_b) of records that differ."""
    return compare(*(written(digest_records(x), "digests") for x in (a, b)), span, fan)


def compare(a: DataFrame, b: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """The audit from the replicas' digests, which are read for the tree and again for the records of differing ranges."""
    digests = [a, b]
    levels = _levels(digests, span, fan)
    left, right = (tree(x, levels, span, fan) for x in digests)
    suspects = None
    for x, y in zip(reversed(left), reversed(right), strict=True):
        if suspects is not None:
            among = suspects.withColumnRenamed("node", "up")
            x, y = (z.withColumn("up", _part("node", fan)).join(among, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        both = x.withColumnRenamed("hash", "one").join(y.withColumnRenamed("hash", "other"), ["file", "node"], "full")
        suspects = written(both.where(~F.col("one").eqNullSafe(F.col("other"))).select("file", "node"), "suspects")

    def bag(digests: DataFrame, side: str) -> DataFrame:
        near = digests.withColumn("node", _range(span)).join(suspects, ["file", "node"], "left_semi")
        alone = F.when(F.col("offset").isNull(), F.col("hash")).alias("alone")
        bags = near.groupBy("file", "offset", alone).agg(*_sums(), F.sum("length").alias(f"length_{side}"), F.min("hash").alias("one"))
        return bags.select("file", "offset", "alone", f"length_{side}", F.when(F.col("n") == 1, F.col("one")).otherwise(F.concat_ws(":", F.lit("bag"), "n", _summed())).alias(f"hash_{side}"))

    x, y = bag(digests[0], "a"), bag(digests[1], "b").withColumnsRenamed({"file": "_file", "offset": "_offset", "alone": "_alone"})
    here = (F.col("file") == F.col("_file")) & F.col("offset").eqNullSafe(F.col("_offset")) & F.col("alone").eqNullSafe(F.col("_alone"))
    both = x.join(y, here, "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    status = F.when(F.col("hash_a").isNull(), "missing_a").when(F.col("hash_b").isNull(), "missing_b").otherwise("corrupt")
    return both.select(F.coalesce("file", "_file").alias("file"), F.coalesce("offset", "_offset").alias("offset"), "length_a", "length_b", "hash_a", "hash_b", status.alias("status"))


PER_FILE = 500


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC record; a null page_id is written 'none', a null url or html is empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "
    parts = [head, url, "\r\nWARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("none")), ">\r\nContent-Length: ", F.octet_length(html).cast("string"), "\r\n\r\n", html, "\r\n\r\n"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _file() -> Column:
    """PER_FILE neighbouring page_ids make a file; pages without an id are dealt to _LOOSE files by the SHA-256 of their record."""
    loose = -1 - F.conv(F.substring("hash_a", 1, 6), 16, 10).cast("long") % _LOOSE
    return F.coalesce(_part("page_id", PER_FILE), loose)


def op2_fixity(spark, sf_dir: str) -> DataFrame:
    """The audit of all pages as an archive against a replica in which every 101st record lost a byte, every 211th is gone and every 307th is cut.

    The archive has files of PER_FILE neighbouring page_ids, in each the records by page_id, url and hash. Both replicas are hashed in
    one pass over the pages, and only digests are ordered to give offsets; equal pages are one row until they have their offsets.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    record = F.col("record")
    flipped = F.concat(F.substring(record, 1, 59), F.lit("#"), F.substring(record, F.lit(61), F.length(record)))
    cut = F.substring(record, F.lit(1), F.floor(F.length(record) / 2).cast("int"))
    hurt = F.when(F.col("page_id") % 307 == 5, cut).when(F.col("page_id") % 101 == 7, flipped).otherwise(record)
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    digest = lambda x, side: (F.octet_length(x).cast("long").alias(f"length_{side}"), F.sha2(x.cast("binary"), 256).alias(f"hash_{side}"))
    narrow = rows.select("page_id", "url", *digest(record, "a"), *digest(hurt, "b")).withColumn("file", _file())
    once = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("times"))
    before = Window.partitionBy("file").orderBy("page_id", "url", "hash_a").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("length_a") * F.col("times")).over(before), F.lit(0).cast("long"))
    each = once.withColumn("first", first).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    placed = written(each.withColumn("offset", F.col("first") + F.col("k") * F.col("length_a")).drop("first", "k", "times"), "digests")
    good = placed.select("file", "offset", F.col("length_a").alias("length"), F.col("hash_a").alias("hash"))
    bad = placed.where(F.coalesce(F.col("page_id") % 211 != 13, F.lit(True))).select("file", "offset", F.col("length_b").alias("length"), F.col("hash_b").alias("hash"))
    return compare(good, bad)


OP2_SQL = f"""
with paged as (
  select page_id, coalesce(url, '') as url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), 'none') || '>'
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages
), page as (
  select *, coalesce(cast(floor(page_id / {PER_FILE}) as bigint), -1 - cast('0x' || sha256(record)[:6] as bigint) % {_LOOSE}) as file from paged
), good as (
  select file, page_id, record, cast(coalesce(sum(strlen(record)) over (partition by file order by page_id nulls first, url, sha256(record) rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from page
), bad as (
  select file, page_id, "offset", case when page_id % 307 = 5 then record[:length(record) // 2] when page_id % 101 = 7 then record[:59] || '#' || record[61:] else record end as record
  from good where coalesce(page_id % 211 <> 13, true)
)
select good.file, good."offset", cast(strlen(good.record) as bigint) as length_a, cast(strlen(bad.record) as bigint) as length_b, sha256(good.record) as hash_a, sha256(bad.record) as hash_b,
  case when bad.record is null then 'missing_b' else 'corrupt' end as status
from good left join bad on good.file = bad.file and good."offset" = bad."offset" where good.record is distinct from bad.record
"""
