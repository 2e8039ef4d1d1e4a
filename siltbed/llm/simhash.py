"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits, each the majority of that bit over the hashes of the text's word shingles. Two texts are linked
if their fingerprints differ in at most three bits; components of links are groups of near copies.

Candidates come from a covering code. Of three differing bits, one half of the fingerprint has at most one, so each
32-bit half is covered by itself with threshold 1: the anchors are the perfect (31, 26) Hamming code times the 32nd bit, of
covering radius 1 over the code's 31 places, so 2**27 anchors a half. A half is sent to every anchor within radius plus
threshold = 2 of it (17 anchors, or 2 where its first 31 bits are a code word): if two halves differ by one bit at most, the
code word nearest one of them is within 2 of the other, so they meet. A covering of all 64 bits at once would need
thousands of replicas for the same guarantee.

How it scales: only distinct fingerprints are replicated, so exact copies cost one row. Per anchor, fingerprints are compared
by popcount, and only a spanning forest of the links leaves a partition, never all pairs. Rows are sorted by anchor in the
JVM and stream through in batches; one group's distinct fingerprints at a time are in memory. Anchors of over `HOT` fingerprints
are split by the other half: cut to six pieces, of which three at least are equal in two halves that differ in three bits, so
one of the 20 choices of three pieces (15 to 17 bits) puts them together; groups shrink by 2**15 and more. How many anchors are hot is
bounded by the replicas over HOT, so their table is joined, and broadcast only where it is small.

Cases: null, empty and word-less texts have fingerprint zero, and link like any other; fewer words than a shingle are one
shingle. Rows that share a doc_id each get a row. A null doc_id never is a component's id unless all of its members' are
null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from siltbed.llm.components import components, forest, with_group
from siltbed.llm.shared import bounded_batches, written
from siltbed.llm.words import LOWER, SPACED, find_words, small_batches, spaced, utf8, xxh64

SHINGLE, BITS = 3, 3
_SEED = 42


def _text_fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned fingerprints of a batch of texts."""
    data, offsets = utf8(column)
    words = find_words(LOWER[data], offsets, SPACED)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(words.starts):
        return out
    body, at = spaced(words, SPACED)  # a shingle is a slice up to its last word's end
    first = words.first
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    last = start + np.repeat(np.minimum(n, shingle), count) - 1
    hashes = xxh64(body, at[start], at[last + 1] - 1, _SEED)
    some = np.flatnonzero(count)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])[some]
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    result = np.zeros((len(some), 8), np.uint8)
    for octet in range(8):
        bits = np.unpackbits(np.ascontiguousarray(octets[:, octet])[:, None], axis=1)
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        result[:, octet] = np.packbits(2 * ones > count[some][:, None], axis=1)[:, 0]
    out[some] = result.reshape(-1).view(">u8")
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns of `carry`, fp: the 64-bit fingerprint as a signed long), one row for each row of docs; no shuffle."""
    names = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = _text_fingerprints(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], [*names, "fp"])

    kinds = "".join(f"{x} {docs.schema[x].dataType.simpleString()}, " for x in names)
    bounded_batches(docs.sparkSession)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}fp long")


def _pairs_by_syndrome() -> np.ndarray:
    """For each syndrome from 1 to 31, the masks of the 15 bit pairs (places from 1, neither the syndrome) that give it."""
    masks = np.zeros((32, 15), np.uint32)
    for s in range(1, 32):
        masks[s] = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s and i != s and i ^ s]
    return masks


_PAIRS = _pairs_by_syndrome()
_PLACES = [np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)) for k in range(5)]
_SPARE = np.uint32(1 << 31)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into `half` (uint32) and the anchors within distance 2 of them."""
    syndrome = sum(((np.bitwise_count(half & p) & 1).astype(np.uint32) << np.uint32(k)) for k, p in enumerate(_PLACES))
    nearest = half ^ np.where(syndrome > 0, np.uint32(1) << ((syndrome - np.uint32(1)) & np.uint32(31)), np.uint32(0)).astype(np.uint32)
    off = np.flatnonzero(syndrome)
    every = np.arange(len(half))
    which = np.concatenate([every, every, np.repeat(off, 15)])
    return which, np.concatenate([nearest, nearest ^ _SPARE, (half[off, None] ^ _PAIRS[syndrome[off]]).reshape(-1)])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for begin in range(0, len(fp), 1 << 15):
            part = fp[begin : begin + (1 << 15)]
            halves = part.view(np.uint64)
            for side in (0, 1):
                which, anchor = anchors(((halves >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                key = anchor.astype(np.int64) | np.int64(side << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[which])], ["anchor", "fp"])


#: Of an anchor's fingerprints; beyond, its group is split.
HOT = 2_000
#: Six pieces of a half, and all choices of three.
_CUTS = [0x1F << 5 * i for i in range(4)] + [0x3F << 20, 0x3F << 26]
_CHOICES = [np.uint64(a | b | c) for a, b, c in combinations(_CUTS, 3)]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint of a hot anchor goes to the 20 choices of three pieces of its other half."""
    for batch in batches:
        anchor, fp = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("anchor", "fp"))
        for begin in range(0, len(fp), 1 << 15):
            a, part = anchor[begin : begin + (1 << 15)], fp[begin : begin + (1 << 15)]
            bits = part.view(np.uint64)
            other = np.where(a >> 32 & 1, bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))
            for k, mask in enumerate(_CHOICES):
                piece = (other & mask).astype(np.int64) | (k + 1 << 32)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(piece), pa.array(part)], ["anchor", "piece", "fp"])


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= bits


#: Groups of up to so many are compared lag by lag over all groups at once; larger ones each by itself.
_SMALL = 24


def _links(new: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within each group; `new` marks the first row of each."""
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(new)))
    group = np.cumsum(new)
    left, right = [], []
    small = np.repeat(size <= _SMALL, size)
    for lag in range(1, min(_SMALL, int(size.max(initial=0)) + 1)):
        i = np.flatnonzero((group[:-lag] == group[lag:]) & small[:-lag]) if lag < len(group) else np.empty(0, np.int64)
        i = i[_near(fp[i], fp[i + lag], bits)]
        left.append(fp[i + lag])
        right.append(fp[i])
    for a, n in zip(begin[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
        rest = fp[a : a + n]
        while len(rest):
            # Grow one component; what it takes leaves the rest, so a dense group is done after a few steps.
            queue, rest, taken = [rest[0]], rest[1:], rest[0]
            while queue and len(rest):
                near = _near(np.full(len(rest), queue.pop()), rest, bits)
                if near.any():
                    found = rest[near]
                    left.append(found)
                    right.append(np.full(len(found), taken))
                    queue.extend(found.tolist())
                    rest = rest[~near]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group (anchor, piece); the last group's rows wait until it is whole."""
    waiting: list[tuple[np.ndarray, ...]] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def take() -> int:
        anchor, piece, fp = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        new = np.ones(len(fp), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        a, b = _links(new, fp, bits)
        if len(a):
            found.append((a, b))
        return len(a)

    for batch in batches:
        rows = tuple(batch.column(x).to_numpy(zero_copy_only=False) for x in ("anchor", "piece", "fp"))
        last = len(rows[0]) - 1
        if last < 0:
            continue
        change = np.flatnonzero((rows[0] != rows[0][last]) | (rows[1] != rows[1][last]))
        cut = int(change[-1]) + 1 if len(change) else 0
        begins = not waiting or waiting[-1][0][-1] != rows[0][0] or waiting[-1][1][-1] != rows[1][0]
        if cut or begins and waiting:
            waiting.append(tuple(x[:cut] for x in rows))
            held += take()
        waiting.append(tuple(x[cut:] for x in rows))
        if held > 1_000_000:
            held = 0
            yield out()
    if waiting:
        take()
    if found:
        yield out()


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, no repeats) within `bits` of each other."""
    if bits > 3:
        raise ValueError("each half is covered for one differing bit: at most 3 bits in all")
    spread = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    crowded = spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    crowded = written(crowded, "anchors")
    rows = spread.withColumn("piece", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        split = spread.join(crowded, "anchor", "left_semi").select("anchor", "fp").mapInArrow(_split, "anchor long, piece long, fp long")
        rows = rows.join(crowded, "anchor", "left_anti").unionByName(split)
    dealt = rows.repartition("anchor", "piece").sortWithinPartitions("anchor", "piece")
    return dealt.mapInArrow(lambda batches: _compare(batches, bits), "a long, b long").distinct()


def _with_components(prints: DataFrame, bits: int) -> DataFrame:
    """prints (doc_id, fp, further columns) with root: the fingerprint that names the component, and component_id."""
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(reps, bits))
    rooted = written(reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = with_group(rooted, "root", F.min("rep").alias("component_id")).select("fp", "root", "component_id")
    return prints.join(ids, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id: the smallest doc_id reachable by links), one row for each row of docs."""
    return _with_components(written(fingerprints(docs, shingle), "simhash"), bits).select("doc_id", "fp", "component_id")


def text_key(docs: DataFrame) -> Column:
    """With the doc_id, what tells rows of docs apart: the MD5 of the text, nothing for null."""
    return F.coalesce(F.md5(docs["text"]), F.lit(""))


def surplus(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(near_id, near_key, again) of the rows beyond the first of each component.

    The first row is that of the smallest doc_id (a null comes last), then of the smallest text_key. `again` is false for the
    keys of rows that all go, and true for the keys of first rows that stand more than once, of which one stays.
    """
    keyed = docs.select("doc_id", "text", text_key(docs).alias("near_key"))
    rows = written(_with_components(written(fingerprints(keyed, shingle, ("near_key",)), "simhash"), bits), "near")
    of_least_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    least = with_group(rows, "root", F.min(F.when(of_least_id, F.col("near_key"))).alias("first_key"))
    is_first = of_least_id & (F.col("near_key") == F.col("first_key"))
    keys = least.groupBy(F.col("doc_id").alias("near_id"), "near_key").agg(F.max(is_first).alias("again"), F.count("*").alias("n"))
    return keys.where("not again or n > 1").select("near_id", "near_key", "again")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of docs, all its columns, for each component: the first as surplus() has it. Unlike rows that share a doc_id, or have none, all stay."""
    # Both sides are dealt by key whatever their size: the surplus may be a third of all rows, and the plan is the same at every scale.
    found = written(surplus(docs, shingle, bits), "near")
    dealt = found.hint("merge")
    key = text_key(docs)
    same = lambda keys: docs["doc_id"].eqNullSafe(keys["near_id"]) & (key == keys["near_key"])
    once = docs.join(dealt, same(dealt), "left_anti")
    again = found.where("again")
    place = "_place"
    while place in map(str.lower, docs.columns):
        place += "_"
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)])))
    kept = docs.join(again, same(again), "left_semi").withColumn(place, first).where(F.col(place) == 1).drop(place)
    return once.unionByName(kept)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# XXH64 in SQL, as its definition has it: 64-bit arithmetic by way of 128 bits.
_PRIMES = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]


def _times(x: str, k: int) -> str:
    return f"cast(cast({x} as uhugeint) * {_PRIMES[k]} % 18446744073709551616 as ubigint)"


def _plus(*x: str) -> str:
    return f"cast(({' + '.join(f'cast({y} as uhugeint)' for y in x)}) % 18446744073709551616 as ubigint)"


def _turn(x: str, bits: int) -> str:
    return f"cast(cast({x} as uhugeint) * {1 << bits} % 18446744073709551616 + (cast({x} as uhugeint) // {1 << 64 - bits}) as ubigint)"


def _bytes(at: str, n: int) -> str:
    """n bytes of the hexadecimal text x from byte `at` (from 0) on, the lowest first."""
    return "cast('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in range(n - 1, -1, -1)) + " as ubigint)"


def _stages() -> str:
    """CTEs from `spelled` (s, x: hexadecimal, n: bytes) to `hashed` (s, h)."""
    seeds = [(_SEED + _PRIMES[0] + _PRIMES[1]) % 2**64, (_SEED + _PRIMES[1]) % 2**64, _SEED, (_SEED - _PRIMES[0]) % 2**64]
    lane = lambda v, k: _times("r" + str(k), 0)
    out = [
        "striped(s, x, n, i, v0, v1, v2, v3) as ("
        f"select s, x, n, 0, {', '.join(f'cast({v} as ubigint)' for v in seeds)} from spelled where n >= 32 union all select s, x, n, i + 1, {', '.join(lane(None, k) for k in range(4))} from ("
        f"select *, {', '.join(_turn(f'a{k}', 31) + f' as r{k}' for k in range(4))} from (select *, {', '.join(_plus(f'v{k}', _times(_bytes(f'32 * i + {8 * k}', 8), 1)) + f' as a{k}' for k in range(4))} from striped where i < n // 32)))"
    ]
    long = _plus(_turn("v0", 1), _turn("v1", 7), _turn("v2", 12), _turn("v3", 18))
    out.append(f"begun as (select s, x, n, 0 as b, {_plus(str(_SEED), str(_PRIMES[4]), 'n')} as h from spelled where n < 32 union all select s, x, n, 32 * i, {_merged(long)} from striped where i = n // 32)")
    last = "begun"
    for k in range(3):
        mixed = _times(_turn(_times(_bytes(f"b + {8 * k}", 8), 1), 31), 0)
        out.append(f"lane{k} as (select s, x, n, b, case when (n - b) // 8 > {k} then {_plus(_times(_turn('y', 27), 0), str(_PRIMES[3]))} else h end as h from (select *, case when (n - b) // 8 > {k} then xor(h, {mixed}) end as y from {last}))")
        last = f"lane{k}"
    four = _times(_bytes("n // 8 * 8", 4), 0)
    out.append(f"four as (select s, x, n, case when n % 8 >= 4 then {_plus(_times(_turn('y', 23), 1), str(_PRIMES[2]))} else h end as h from (select *, case when n % 8 >= 4 then xor(h, {four}) end as y from {last}))")
    last = "four"
    for k in range(3):
        out.append(f"one{k} as (select s, x, n, case when n % 4 > {k} then {_times(_turn('y', 11), 0)} else h end as h from (select *, case when n % 4 > {k} then xor(h, {_times(_bytes(f'n // 4 * 4 + {k}', 1), 4)}) end as y from {last}))")
        last = f"one{k}"
    for k, (bits, prime) in enumerate(((33, 1), (29, 2))):
        out.append(f"mixed{k} as (select s, {_times(f'xor(h, h >> {bits})', prime)} as h from {last})")
        last = f"mixed{k}"
    return ", ".join([*out, f"hashed as (select s, xor(h, h >> 32) as h from {last})"])


def _merged(h: str) -> str:
    for k in range(4):
        h = _plus(_times(f"xor({h}, {_times(_turn(_times(f'v{k}', 1), 31), 0)})", 0), str(_PRIMES[3]))
    return _plus(h, "n")


OP5_SQL = rf"""
with recursive doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents
), shingle as (
  select r, array_to_string(w[p:p + 2], ' ') as s from (select r, w, unnest(range(1, greatest(len(w) - 1, 2))) as p from doc where len(w) > 0)
), spelled as (
  select s, hex(encode(s)) as x, strlen(s) as n from (select distinct s from shingle)
), {_stages()}
, counted as (
  select r, count(*) as n, {", ".join(f"count(*) filter (where (h >> {b}) & 1 = 1) as c{b}" for b in range(64))} from shingle join hashed using (s) group by r
), print as (
  select doc.r, doc_id, coalesce({" + ".join(f"(case when 2 * c{b} > n then cast({1 << b} as uhugeint) else 0 end)" for b in range(64))}, 0)::ubigint as fp from doc left join counted on doc.r = counted.r
), node as (
  select fp, min(doc_id) as least from print group by fp
), near as (
  select a.fp as a, b.fp as b from node a join node b on bit_count(xor(a.fp, b.fp)) <= 3
), reached as (
  select fp as a, fp as b from node union select reached.a, near.b from reached join near on reached.b = near.a
), rooted as (
  select a as fp, min(least) as component_id from reached join node on reached.b = node.fp group by a
)
select doc_id, printf('%016x', print.fp) as fingerprint, component_id from print join rooted on print.fp = rooted.fp
"""
