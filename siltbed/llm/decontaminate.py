"""Benchmark decontamination by a prefix-filtered set join.

The sets are the item windows: each `window` consecutive words of a benchmark item, or the whole of a shorter item. A set's
tokens are its shingles of `shingle` words (all its words, if it has fewer). Shingles are ordered by rarity, counted over
the whole corpus; as containment must be whole, the necessary prefix of a window is its one rarest shingle. Every shingle
of every document probes the prefix index; a hit's offset fixes where the window would start (positional bound), that
place must lie in the document with all its words (length bound), and then the words are compared, by their hashes and
at last byte by byte.

How it scales: a benchmark of at most `block_windows` windows is broadcast, and documents are never shuffled: both passes (rarity, join)
stream over them. A larger benchmark never reaches the driver or a task whole. Its shingles set bits in a map of fixed size (2 ** `_MAP` bits, which is
broadcast); the places of documents that hit the map, a few in a hundred by chance, go out with the words around them,
are counted for rarity, and meet the windows' prefixes by a join on the shingle, where the words are compared. The documents are read
once, and what is shuffled is hits, not texts.

Cases: a null text has no words; an item without words has no windows, an item id that is null counts as the id 'null';
equal windows of several items, or rows that repeat an item, are one window with all those ids. Rows that share a doc_id
each get a row. Other columns are ignored; an empty benchmark leaves every document clean, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import bounded_batches, written
from siltbed.llm.words import ALNUM, LOWER, Words, find_words, small_batches, spaced, utf8, whole_windows, window_hashes

WINDOW, SHINGLE = 10, 5
BLOCK_WINDOWS = 200_000
#: Of the map of a large benchmark's shingles: the logarithm of its bits.
_MAP = 28


def _words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    return find_words(LOWER[data], offsets, ALNUM)


class Block:
    """Distinct windows of some items, with the shingles that may stand for them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, shingle: int) -> None:
        ids: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                ids.setdefault(tuple(words[k : k + size]), set()).add(item)
        self.windows = sorted(ids)
        self.ids = [sorted(ids[w]) for w in self.windows]
        self.shingles: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        by_size: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, w in enumerate(self.windows):
            size = min(shingle, len(w))
            hashes = _words(pa.array([b" ".join(w).decode()])).hashes()
            for offset, h in enumerate(window_hashes(hashes, size).tolist()):
                by_size.setdefault(size, {}).setdefault(h, []).append((k, offset))
        for size, found in by_size.items():
            keys = sorted(found)
            self.shingles[size] = (np.array(keys, np.uint64), [found[x] for x in keys])

    def keep_rarest(self, counts: dict[tuple[int, int], int]) -> None:
        """Leaves each window the one shingle with the least count; ties go to the smaller hash, then the earlier place."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for size, (keys, uses) in self.shingles.items():
            for i, (key, where) in enumerate(zip(keys.tolist(), uses, strict=True)):
                for k, offset in where:
                    best[k] = min(best.get(k, (1 << 62, 0, 0, 0)), (counts.get((size, i), 0), key, offset, size))
        new: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (_, key, offset, size) in best.items():
            new.setdefault(size, {}).setdefault(key, []).append((k, offset))
        self.shingles = {size: (np.array(sorted(x), np.uint64), [x[key] for key in sorted(x)]) for size, x in new.items()}

    def pack(self) -> None:
        """Arrays for the join: uses of each shingle in rows, and the words' hashes of each window."""
        self.uses = {}
        for size, (_, where) in self.shingles.items():
            flat = np.array([x for w in where for x in w], np.int64).reshape(-1, 2)
            self.uses[size] = (np.concatenate([[0], np.cumsum([len(w) for w in where])]), flat[:, 0], flat[:, 1])
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.hashes = _words(pa.array([b" ".join(w).decode() for w in self.windows], pa.string())).hashes()
        self.at = np.concatenate([[0], np.cumsum(self.size)])


class _Probe:
    """Membership of hashes in an ascending array, by a table over their low bits first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = min(24, max(12, len(keys).bit_length() + 5))
        self.low = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[keys & self.low] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are found, and which key each is."""
        at = np.flatnonzero(self.seen[hashes & self.low])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def _block(benchmark: DataFrame, window: int, shingle: int, block_windows: int) -> Block | None:
    """All items, if they have at most block_windows windows; items stream to the driver, and no more than that many are held."""
    bounded_batches(benchmark.sparkSession)
    held, size = [], 0
    for row in _items(benchmark).toLocalIterator():
        w = _words(pa.array([row.text], pa.string()))
        size += max(len(w.starts) - window + 1, min(len(w.starts), 1))
        if size > block_windows:
            return None
        raw = w.data.tobytes()
        held.append((row.item_id, [raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]))
    return Block(held, window, shingle)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")


def _rarity(docs: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all documents."""
    keys = docs.sparkSession.sparkContext.broadcast({size: x[0] for size, x in block.shingles.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {size: _Probe(x) for size, x in keys.value.items()}
        totals = {size: np.zeros(len(x), np.int64) for size, x in keys.value.items()}
        for batch in small_batches(batches):
            words = _words(batch.column("text"))
            hashes = words.hashes()
            for size, probe in probes.items():
                at, key = probe(window_hashes(hashes, size))
                key = key[whole_windows(words.first, size)[at]]
                totals[size] += np.bincount(key, minlength=len(totals[size]))
        for size, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size)), pa.array(some), pa.array(total[some])], ["size", "key", "n"])

    counted = docs.select("text").mapInArrow(run, "size long, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
    out = {(r["size"], r["key"]): r["n"] for r in counted.collect()}  # at most the block's shingles
    keys.unpersist()
    return out


def _hits(block: Block, probes: dict[int, _Probe], words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that occur in a batch: document, first word (in the batch), and window, compared byte by byte."""
    first = words.first
    starts, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size, probe in probes.items():
        at, key = probe(window_hashes(hashes, size))
        bound, window, offset = block.uses[size]
        many = bound[key + 1] - bound[key]
        use = np.repeat(bound[key] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        starts.append(np.repeat(at, many) - offset[use])
        which.append(window[use])
    start, window = np.concatenate(starts), np.concatenate(which)
    doc = np.searchsorted(first, start, "right") - 1
    fits = (start >= 0) & (doc < len(first) - 1)
    fits[fits] = start[fits] + block.size[window[fits]] <= first[doc[fits] + 1]
    start, window, doc = start[fits], window[fits], doc[fits]
    same = np.ones(len(start), bool)
    for k in range(int(block.size[window].max(initial=0))):
        more = same & (block.size[window] > k)
        same[more] = hashes[start[more] + k] == block.hashes[block.at[window[more]] + k]
    start, window, doc = start[same], window[same], doc[same]
    raw = words.data.tobytes()
    read = [tuple(raw[a:b] for a, b in zip(words.starts[s:e].tolist(), words.ends[s:e].tolist(), strict=True)) for s, e in zip(start.tolist(), (start + block.size[window]).tolist(), strict=True)]
    exact = np.fromiter((x == block.windows[w] for x, w in zip(read, window.tolist(), strict=True)), bool, len(read))
    return doc[exact], start[exact], window[exact]


def _join(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n_words, hits: maximal runs of hit words, end exclusive, items) for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        probes = {size: _Probe(x[0]) for size, x in block.shingles.items()}
        for batch in small_batches(batches):
            words = _words(batch.column("text"))
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            if probes:
                for d, s, w in zip(*(x.tolist() for x in _hits(block, probes, words, words.hashes())), strict=True):
                    begin = s - int(words.first[d])
                    spans.setdefault(d, []).append((begin, begin + len(block.windows[w])))
                    items.setdefault(d, set()).update(block.ids[w])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.counts(), pa.int64()),
                    pa.array([_union(spans.get(d, [])) for d in range(batch.num_rows)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(items.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "hits", "items"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, hits array<struct<start: long, end: long>>, items array<string>")


# Beyond one block


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, words: of a window, joined by spaces, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = _words(batch.column("text"))
            body, at = spaced(words, ALNUM)
            raw, items = body.tobytes(), batch.column("item_id").to_pylist()
            for row, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                n = min(window, b - a)
                starts = np.arange(a, b - n + 1) if n else np.empty(0, np.int64)
                some = [raw[x:y].decode() for x, y in zip(at[starts].tolist(), (at[starts + n] - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([items[row]] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([n] * len(some), pa.int32())], ["item_id", "words", "n"])

    return _items(benchmark).mapInArrow(run, "item_id string, words string, n int").distinct()


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(words, size, hash, offset) of the shingles of windows (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "words"):
            words = _words(batch.column("words"))
            hashes, n = words.hashes(), words.counts()
            for size in np.unique(np.minimum(n, shingle)).tolist():
                rows = np.flatnonzero(np.minimum(n, shingle) == size)
                many = n[rows] - size + 1
                row = np.repeat(rows, many)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                found = window_hashes(hashes, size)[words.first[row] + offset].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("words").take(pa.array(row)), pa.array(np.full(len(row), size, np.int32)), pa.array(found), pa.array(offset.astype(np.int32))], ["words", "size", "hash", "offset"])

    return windows.select("words").distinct().mapInArrow(run, "words string, size int, hash long, offset int")


def _bit_map(shingles: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of shingles, and a bit for the top of each shingle's hash; 2 ** (_MAP - 6) longs reach the driver at most."""
    at = F.call_function("shiftrightunsigned", "hash", F.lit(64 - _MAP))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    bits = np.zeros(1 << (_MAP - 6), np.int64)
    for r in shingles.groupBy(F.floor(at / 64).alias("at")).agg(F.bit_or(one).alias("bits")).toLocalIterator():
        bits[r["at"]] = r["bits"]
    return sorted(r["size"] for r in shingles.select("size").distinct().collect()), bits  # at most as many as a shingle has words


def _near_hits(docs: DataFrame, sizes: list[int], bits: np.ndarray, window: int, shingle: int) -> DataFrame:
    """(doc_id, mark, size, hash, place, lead, near) of the places of documents whose shingle hits the map; near: the words around, `lead` of them before the place."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((sizes, bits))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits = shared.value
        for batch in small_batches(batches):
            words = _words(batch.column("text"))
            hashes = words.hashes()
            body, at = spaced(words, ALNUM)
            raw = body.tobytes()
            for size in sizes:
                found = window_hashes(hashes, size)
                slot = found >> np.uint64(64 - _MAP)
                hit = (bits[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1)
                place = np.flatnonzero((hit == 1) & whole_windows(words.first, size))
                doc = np.searchsorted(words.first, place, "right") - 1
                low = np.maximum(place - (window - size), words.first[doc])
                high = np.minimum(place + window, words.first[doc + 1])
                near = [raw[a:b].decode() for a, b in zip(at[low].tolist(), (at[high] - 1).tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(doc)), batch.column("mark").take(pa.array(doc)), pa.array(np.full(len(doc), size, np.int32)), pa.array(found[place].view(np.int64)), pa.array(place - words.first[doc]), pa.array((place - low).astype(np.int32)), pa.array(near, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "size", "hash", "place", "lead", "near"])

    return docs.mapInArrow(run, f"doc_id {kind}, mark string, size int, hash long, place long, lead int, near string")


def _marked(docs: DataFrame) -> DataFrame:
    """What tells rows apart that share a doc_id: equal texts have equal results."""
    return docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mark"), "text")


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Windows that documents hold as (doc_id, mark, start, n, words), and (item_id, words, n) of all windows."""
    windows = written(_windows(benchmark, window), "windows")
    shingles = written(_window_shingles(windows, shingle), "shingles")
    near = written(_near_hits(_marked(docs), *_bit_map(shingles), window, shingle), "near")
    counts = near.groupBy("size", "hash").agg(F.count("*").alias("uses"))
    told = shingles.join(counts, ["size", "hash"], "left").select("words", F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "hash", "offset", "size").alias("s"))
    prefix = told.groupBy("words").agg(F.min("s").alias("s")).select("words", "s.size", "s.hash", "s.offset")
    prefix = prefix.withColumn("n", F.size(F.split("words", " ")))
    met = near.join(prefix, ["size", "hash"])
    there = F.array_join(F.slice(F.split("near", " "), F.greatest(F.col("lead") - F.col("offset"), F.lit(0)) + 1, F.col("n")), " ")
    hits = met.where((F.col("lead") >= F.col("offset")) & (there == F.col("words")))
    return hits.select("doc_id", "mark", (F.col("place") - F.col("offset")).alias("start"), "n", "words").distinct(), windows


def _join_large(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """As _join."""
    hits, windows = _joined(docs, benchmark, window, shingle)
    hits = written(hits, "hits")
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start: long, end: long>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    runs = hits.groupBy("doc_id", "mark").agg(F.collect_set(span).alias("spans"))  # a document's own words bound them
    items = hits.select("doc_id", "mark", "words").distinct().join(windows.select("item_id", "words"), "words").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = runs.join(items.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), merged.alias("hits"), "items")
    rows = _marked(docs).mapInArrow(_counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark string, n_words long")
    found = rows.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    none = F.array().cast("array<struct<start: long, end: long>>")
    return found.select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(_words(batch.column("text")).counts(), pa.int64())], ["doc_id", "mark", "n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs, all columns, without the rows whose text holds a window."""
    block = _block(benchmark, window, shingle, block_windows)
    if block is None:
        hits = _joined(docs, benchmark, window, shingle)[0].select("doc_id", "mark").distinct()
        return docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == hits["mark"]), "left_anti")
    if not block.windows:
        return docs
    block.keep_rarest(_rarity(docs, block))
    block.pack()
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        probes = {size: _Probe(x[0]) for size, x in block.shingles.items()}
        for batch in small_batches(batches):
            words = _words(batch.column("text"))
            clean = np.ones(batch.num_rows, bool)
            clean[_hits(block, probes, words, words.hashes())[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _union(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, hits, items, n_hit) for each row of docs; hits are runs of words of that row's text."""
    block = _block(benchmark, window, shingle, block_windows)
    if block is None:
        out = _join_large(docs, benchmark, window, shingle)
    else:
        if block.windows:
            block.keep_rarest(_rarity(docs, block))
        block.pack()
        out = _join(docs, block)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", "hits", "items", n_hit.alias("n_hit"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item as (
  select coalesce(cast(item_id as varchar), 'null') as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), win as (
  select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as s
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from item where len(w) > 0)
), size as (
  select distinct n from win
), place as (
  select r, p, n, array_to_string(w[p:p + n - 1], ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from doc, size where len(w) >= n)
), hit as (
  select place.r, place.p, place.n, win.item_id from place join win on place.n = win.n and place.s = win.s
), word as (
  select r, count(distinct p + i) as n_hit from (select distinct r, p, unnest(range(0, n)) as i from hit) group by r
), named as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id from hit) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join word on doc.r = word.r left join named on doc.r = named.r
"""
