"""Exact substring dedup by fixed-block anchors.

Every text's non-overlapping blocks of `block` words are the index; every rolling window of as many words probes it. A
repeat of `window` >= 2 * block - 1 words holds a whole block of either text, so each of its places has a probe that hits.
Each hit is then extended over its neighbouring words: every run of `window` words around it is read out (words joined by one space)
and stands for its words by a BLAKE2b digest of 128 bits; runs whose digests meet again anywhere are repeats, and neighbouring ones join to
maximal exact repeats. Hashes of 64 bits and less only choose what is read out.

How it scales: texts are shuffled once into buckets of about `bucket_bytes`, and that exchange serves all three passes. A text's
bucket is drawn from its id, its words and its place in the input, as any place is right: neither an id that a third of the rows share
nor exact copies fill a bucket. Buckets and hash ranges are dealt to partitions by their number, one each. What buckets exchange are
sorted, packed sets of keys, cut by hash range, so a passage that millions of documents share arrives once from each bucket, and
no pair of documents is ever formed. Such sets number buckets times ranges; buckets therefore grow with the square root of the corpus, from 12 MB at 70 GB
to 64 MB at 2 TB, so that a set keeps some 2 KB and their number grows in proportion. Probes are cut to `key bits` that grow with the corpus.

Cases: a null or empty text has no words and comes back with kept_text ''. Rows that share a doc_id (null too) are
separate texts: each gets a row and each counts as a place. Ties, as all places of a repeat are treated alike: every place
is removed, the first included. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import shares, text_bytes
from siltbed.llm.words import SPACED, find_words, small_batches, spaced, utf8, whole_windows, window_hashes

U = np.uint64
BLOCK, WINDOW = 18, 35
#: Bounds of a bucket's texts, and what a set of keys should have at least, in bytes.
_LEAST_BUCKET, _MOST_BUCKET, _SET = 12 << 20, 64 << 20, 2 << 10
_SETS = "part int, bucket int, body binary"


def pack(sorted_keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as differences of the least fitting width; the first byte is the width."""
    steps = np.diff(sorted_keys, prepend=U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(body: bytes) -> np.ndarray:
    width = body[0]
    steps = np.zeros(((len(body) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(body, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


@dataclass
class _Bucket:
    """All texts of a bucket: word hashes, each row's first word, and the words themselves, one space after each."""

    hashes: np.ndarray
    first: np.ndarray
    body: bytes
    at: np.ndarray

    def digests(self, starts: np.ndarray, size: int) -> list[bytes]:
        """Of the runs of `size` words from each start on."""
        made, body = hashlib.blake2b, memoryview(self.body)
        return [made(body[a:b], digest_size=16).digest() for a, b in zip(self.at[starts].tolist(), (self.at[starts + size] - 1).tolist(), strict=True)]


def _bucket(column: pa.ChunkedArray) -> _Bucket:
    hashes, first, bodies, places, total, length = [np.empty(0, U)], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)], 0, 0
    for batch in small_batches(iter(pa.table([column], ["text"]).to_batches())):
        words = find_words(*utf8(batch.column("text")), SPACED)
        body, at = spaced(words, SPACED)
        hashes.append(words.hashes())
        first.append(words.first[1:] + total)
        bodies.append(body.tobytes())
        places.append(at[1:] + length)
        total += len(words.starts)
        length += len(body)
    return _Bucket(np.concatenate(hashes), np.concatenate(first), b"".join(bodies), np.concatenate(places))


def _sets(bucket: int, parts: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(parts, pa.int32()), "bucket": pa.array([bucket] * len(bodies), pa.int32()), "body": pa.array(bodies, pa.binary())})


def _by_range(keys: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of ascending keys of `bits` bits that go to each part, empty ones left out."""
    edges = [(i << bits) // parts for i in range(parts + 1)]
    cuts = np.searchsorted(keys, np.array(edges[1:-1], np.uint64)) if parts > 1 else np.empty(0, np.int64)
    cuts = np.concatenate([[0], cuts, [len(keys)]])
    for part in np.flatnonzero(np.diff(cuts)):
        yield int(part), int(cuts[part]), int(cuts[part + 1])


def _unique(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending unique keys, whether each occurs more than once, and whether any of its places is flagged."""
    keys = np.sort((keys << U(1)) | flags.astype(np.uint64))
    plain = keys >> U(1)
    new = np.ones(len(plain), bool)
    new[1:] = plain[1:] != plain[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(plain)))
    return plain[at], size > 1, (keys[at + size - 1] & U(1)).astype(bool)


def _probes(hashes: np.ndarray, block: int, bits: int) -> np.ndarray:
    return window_hashes(hashes, block) >> U(64 - bits)


def _probe(key: tuple, table: pa.Table, block: int, bits: int, parts: int) -> pa.Table:
    """All rolling windows of a bucket: (key, occurs more than once here, is an indexed block here)."""
    own = _bucket(table.column("text"))
    keys, whole = _probes(own.hashes, block, bits), whole_windows(own.first, block)
    start = np.repeat(own.first[:-1], np.diff(own.first))[: len(keys)]
    aligned = (np.arange(len(keys)) - start) % block == 0
    keys, more, indexed = _unique(keys[whole], aligned[whole])
    ids, bodies = [], []
    for part, a, b in _by_range(keys, bits, parts):
        ids.append(part)
        bodies.append(pack((keys[a:b] << U(2)) | (more[a:b].astype(np.uint64) << U(1)) | indexed[a:b].astype(np.uint64)))
    return _sets(key[0].as_py(), ids, bodies)


def _groups(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of groups of ordered rows, of which all but the first row of each are `same` as the one before."""
    at = np.flatnonzero(~same)
    return at, np.diff(np.append(at, len(same)))


def _like_last(*columns: np.ndarray) -> np.ndarray:
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for x in columns:
        same[1:] &= x[1:] == x[:-1]
    return same


def _hits(key: tuple, table: pa.Table) -> pa.Table:
    """Of a hash range, the keys that occur at two places or more and are indexed somewhere, by bucket."""
    buckets = table.column("bucket").to_pylist()
    bodies = [unpack(x.as_py()) for x in table.column("body")]
    packed = np.concatenate(bodies)
    order = np.argsort(packed >> U(2), kind="stable")
    own = packed[order]
    at, size = _groups(_like_last(own >> U(2)))
    flags = np.bitwise_or.reduceat(own & U(3), at)
    repeated = ((size > 1) | (flags >= U(2))) & (flags & U(1) == U(1))
    which = np.zeros(len(packed), bool)
    which[order] = np.repeat(repeated, size)
    out, ids, begin = [], [], 0
    for bucket, body in zip(buckets, bodies, strict=True):
        found = (body >> U(2))[which[begin : begin + len(body)]]
        begin += len(body)
        if len(found):
            ids.append(bucket)
            out.append(pack(found))
    return pa.table({"bucket": pa.array(ids, pa.int32()), "body": pa.array(out, pa.binary())})


def _found(table: pa.Table) -> np.ndarray:
    sets = [unpack(x.as_py()) for x in table.column("body")]
    return np.sort(np.concatenate(sets)) if sets else np.empty(0, np.uint64)


@dataclass
class _Runs:
    """Distinct runs of words, ascending by digest (the last bit left out): `more` of those that occur again here; `number` of each start's."""

    high: np.ndarray
    low: np.ndarray
    more: np.ndarray
    number: np.ndarray

    def body(self, a: int, b: int) -> bytes:
        return pack(self.high[a:b]) + (self.low[a:b] | self.more[a:b]).astype("<u8").tobytes()


def _unpack_runs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(body) - 1) // (body[0] + 8)
    return unpack(body[: 1 + n * body[0]]), np.frombuffer(body, "<u8", offset=1 + n * body[0])


def _runs(own: _Bucket, at: np.ndarray, window: int) -> _Runs:
    halves = np.frombuffer(b"".join(own.digests(at, window)), "<u8").reshape(-1, 2)
    high, low = halves[:, 0], halves[:, 1] & ~U(1)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = ~_like_last(high, low)
    first, size = _groups(~new)
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(new) - 1
    return _Runs(high[first], low[first], size > 1, number)


def _is_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Membership in an ascending array; a table over the low bits sorts out most keys first."""
    out = np.zeros(len(keys), bool)
    if not len(among) or not len(keys):
        return out
    bits = min(24, max(8, len(among).bit_length() + 3))
    seen = np.zeros(1 << bits, bool)
    seen[among & U((1 << bits) - 1)] = True
    maybe = np.flatnonzero(seen[keys & U((1 << bits) - 1)])
    at = np.minimum(np.searchsorted(among, keys[maybe]), len(among) - 1)
    out[maybe] = among[at] == keys[maybe]
    return out


def _candidates(own: _Bucket, hits: np.ndarray, block: int, window: int, bits: int) -> np.ndarray:
    """Starts of the runs of `window` words that hold a hit."""
    flagged = _is_in(_probes(own.hashes, block, bits), hits) & whole_windows(own.first, block)
    sums = np.concatenate([[0], np.cumsum(flagged)])
    at = np.flatnonzero(whole_windows(own.first, window))
    return at[sums[at + window - block + 1] > sums[at]]


def _extend(key: tuple, docs: pa.Table, found: pa.Table, block: int, window: int, bits: int, parts: int) -> pa.Table:
    """The distinct runs of `window` words that hold a hit, and the hits themselves, which `_confirm` sends back."""
    if not found.num_rows or not docs.num_rows:
        return _sets(0, [], [])
    bucket, hits, own = docs.column("bucket")[0].as_py(), _found(found), _bucket(docs.column("text"))
    runs = _runs(own, _candidates(own, hits, block, window, bits), window)
    cut = list(_by_range(runs.high >> U(1), 63, parts))
    return _sets(bucket, [part for part, _, _ in cut] + [bucket % parts], [b"r" + runs.body(a, b) for _, a, b in cut] + [b"h" + pack(hits)])


_ANSWERS = "bucket int, part int, body binary"


def _confirm(key: tuple, table: pa.Table) -> pa.Table:
    """Of a digest range, which runs occur at two places or more: for each bucket a bit for each run it sent, in order. Hits pass, as part -1."""
    buckets, bodies = table.column("bucket").to_pylist(), table.column("body").to_pylist()
    answers = [(bucket, -1, body[1:]) for bucket, body in zip(buckets, bodies, strict=True) if body[:1] == b"h"]
    sent = [(bucket, *_unpack_runs(body[1:])) for bucket, body in zip(buckets, bodies, strict=True) if body[:1] == b"r"]
    if sent:
        high, low = np.concatenate([x for _, x, _ in sent]), np.concatenate([x for _, _, x in sent])
        order = np.lexsort((low >> U(1), high))
        at, size = _groups(_like_last(high[order], low[order] >> U(1)))
        which = np.zeros(len(high), bool)
        which[order] = np.repeat((size > 1) | (np.bitwise_or.reduceat(low[order] & U(1), at) == U(1)), size)
        ends = np.cumsum([len(x) for _, x, _ in sent])
        answers += [(bucket, key[0].as_py(), np.packbits(bits).tobytes()) for (bucket, _, _), bits in zip(sent, np.split(which, ends[:-1]), strict=True) if bits.any()]
    out = list(zip(*answers, strict=True)) or [[], [], []]
    return pa.table({"bucket": pa.array(out[0], pa.int32()), "part": pa.array(out[1], pa.int32()), "body": pa.array(out[2], pa.binary())})


def _repeats(own: _Bucket, answers: pa.Table, block: int, window: int, bits: int, parts: int) -> np.ndarray:
    """Starts of the runs that were confirmed: the same runs as in `_extend`, with their bits."""
    told = dict(zip(answers.column("part").to_pylist(), answers.column("body").to_pylist(), strict=True))
    if len(told) < 2:
        return np.empty(0, np.int64)
    at = _candidates(own, unpack(told[-1]), block, window, bits)
    runs = _runs(own, at, window)
    confirmed = np.zeros(len(runs.high), bool)
    for part, a, b in _by_range(runs.high >> U(1), 63, parts):
        if part in told:
            confirmed[a:b] = np.unpackbits(np.frombuffer(told[part], np.uint8), count=b - a)
    return at[confirmed[runs.number]]


def _finish(key: tuple, docs: pa.Table, answers: pa.Table, block: int, window: int, bits: int, parts: int) -> pa.Table:
    """The bucket's documents without the words of confirmed runs."""
    own = _bucket(docs.column("text"))
    covered = np.zeros(len(own.hashes) + 1, np.int32)
    at = _repeats(own, answers, block, window, bits, parts)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    gone = np.cumsum(covered[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = total[own.first[1:]] - total[own.first[:-1]]
    body, place = own.body, own.at
    texts, spans = [], []
    for a, b, n in zip(own.first[:-1].tolist(), own.first[1:].tolist(), n_removed.tolist(), strict=True):
        if not n:
            texts.append(body[place[a] : max(place[b] - 1, place[a])])
            spans.append([])
            continue
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).reshape(-1, 2)
        spans.append([{"start": x, "end": y} for x, y in turn.tolist()])
        kept = zip([a, *(turn[:, 1] + a).tolist()], [*(turn[:, 0] + a).tolist(), b], strict=True)
        texts.append(b" ".join([body[place[x] : place[y] - 1] for x, y in kept if x < y]))
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_words": pa.array(np.diff(own.first)),
            "n_removed": pa.array(n_removed),
            "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats: maximal runs of removed words, end exclusive, kept_text: kept words joined by a space)."""
    block = block or (window + 1) // 2
    if not 0 < 2 * block - 1 <= window:
        raise ValueError("a repeat must hold a whole block: 2 * block - 1 <= window")
    spark = docs.sparkSession
    total = text_bytes(docs)
    bucket_bytes = bucket_bytes or min(_MOST_BUCKET, max(_LEAST_BUCKET, math.isqrt(_SET * total)))
    buckets = shares(total, bucket_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # About 6 bytes a word; 13 bits over the logarithm leave one chance hit in some thousand probes, which the extension sorts out.
    bits = min(60, max(40, (total // 6 + 1).bit_length() + 13))
    parts = shares(total, bucket_bytes, 8)
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    dealt = docs.select(bucket.alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionById(buckets, F.col("bucket"))
    each = dealt.groupBy("bucket")
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def by(sets: DataFrame, column: str, n: int):
        return sets.repartitionById(n, F.col(column)).groupBy(column)

    probes = each.applyInArrow(lambda key, table: _probe(key, table, block, bits, parts), _SETS)
    hits = by(probes, "part", parts).applyInArrow(_hits, "bucket int, body binary")
    runs = each.cogroup(by(hits, "bucket", buckets)).applyInArrow(lambda key, docs, found: _extend(key, docs, found, block, window, bits, parts), _SETS)
    confirmed = by(runs, "part", parts).applyInArrow(_confirm, _ANSWERS)
    return each.cogroup(by(confirmed, "bucket", buckets)).applyInArrow(
        lambda key, docs, answers: _finish(key, docs, answers, block, window, bits, parts),
        f"doc_id {doc_type}, n_words long, n_removed long, repeats array<struct<start: long, end: long>>, kept_text string",
    )


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select r, p, array_to_string(w[p:p + 34], ' ') as s
  from (select r, w, unnest(range(1, len(w) - 33)) as p from doc where len(w) >= 35)
), again as (
  select r, p from (select r, p, count(*) over (partition by md5(s)) as n from win) where n > 1
), gone as (
  select distinct r, p + i as k from again, (select unnest(range(0, 35)) as i)
), word as (
  select r, k, w[k] as t from (select r, w, unnest(range(1, len(w) + 1)) as k from doc)
), kept as (
  select word.r, string_agg(t, ' ' order by word.k) as s, count(*) as n from word anti join gone on word.r = gone.r and word.k = gone.k group by word.r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from doc left join kept on doc.r = kept.r
"""
