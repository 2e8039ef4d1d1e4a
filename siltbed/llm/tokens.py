"""Token ids on Parquet: documents in ascending doc_id order, encoded once, in shards that allow selective reads.

Layout: one row a document with (shard, place, doc_id, n_tokens, ids). `ids` is a list column, dictionary-encoded (a
vocabulary of some 50,000 fits one dictionary page, so an id takes 16 bits before compression); the number columns are
written without a dictionary by version 2 pages, hence delta-encoded. Row groups and pages are bounded by size and by
rows, and each page has its column index: a reader of a doc_id range, or of the metadata only, skips the rest. `place` is a
document's offset in its shard; the manifest beside the shards holds each shard's token total, from which prefix sums give
global offsets. So one pass encodes, and no second pass over the tokens is needed to place them.

How it scales: one range shuffle of the texts by doc_id, then everything streams. Rows that share a doc_id, null too, are ranged
on by a hash of their text, and equal rows by their place in the input, so no id and no text is one task's. The manifest has
a row for each shard (an output partition), and only that is ever gathered or broadcast.

Encoding is the tokenizers library's, with a memo (a lone word goes to its model directly): texts are cut before white space that follows a character that can't
join it and before marks that follow a letter, each distinct short piece is encoded once, and the ids are put together by array lookups. A piece is looked up by
hash and then compared byte by byte; longer pieces, and any that only share a hash, are encoded by themselves. Neither kind of vocabulary
used here can make a token across such a cut; tests compare with whole-text encoding.

Cases: a null text is empty, and gives the end id alone. Rows that share a doc_id stay separate rows, in the order of xxhash64 of
their texts; null doc_ids come first. Special tokens' strings in a text are encoded as the library does by default. Other columns
are ignored. An empty table gives empty shards and no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.shared import bounded_batches, shares, text_bytes
from siltbed.llm.words import Numbers, Octets, hash_octets, kept, octets, release, small_batches, span_octets, utf8
from siltbed.sources.folders import new_folder

#: Beyond so many, shards grow instead: the manifest stays a table that a driver can hold.
_MOST_SHARDS = 50_000
#: Octets of text that are encoded at once: arrays over their pieces take many times as much.
_TEXT_BYTES = 256 << 10
#: Pieces that are encoded at once; the library's results are much larger than their ids.
_AT_ONCE = 5_000
#: Of the memo of a worker: slots at first as a power of two, the most pieces, after which it starts anew (one text may have more), and the octets of the longest.
_MEMO_BITS, _MEMO_PIECES, _MEMO_OCTETS = 20, 500_000, 3
#: Written by the shard writer; a smaller row group or page makes selective reads cheaper and full reads dearer.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#shard": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[65:91] = _ASCII_LETTERS[97:123] = True
#: Byte-level vocabularies write each byte as a character: visible ones of Latin-1 as themselves, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
#: Words that tell how a vocabulary treats case, spaces and letters beyond ASCII.
_SAMPLES = [" the", "The", " Straße", "École", " año", "ÑANDÚ", " a", "Z", " íntegramente", "THENCE", " überGang", "ÿ", " Àà", "xyzzy"]
_MARKS = np.zeros(256, bool)
_MARKS[0x21:0x7F] = True
_MARKS[48:58] = False
_MARKS &= ~_ASCII_LETTERS


class MemoTokenizer:
    """encode(): ids of all texts of a batch and n + 1 bounds. The memo holds the bytes of its pieces, and only equal bytes share an entry."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # Marks that an added token has may stand inside it, so no text is cut there.
        added = "".join(x["content"] for x in json.loads(definition).get("added_tokens") or []).encode()
        self.cutters = _MARKS.copy()
        self.cutters[[0x20, 0x0A]] = True
        self.cutters[list(added)] = False
        self.model = self.tokenizer.model
        self.direct = self._find_direct()
        self._clear()

    @classmethod
    def of(cls, definition: str) -> MemoTokenizer:
        """One for each definition and worker process."""
        return kept(("tokenizer", hashlib.md5(definition.encode()).hexdigest()), lambda: cls(definition))

    def _clear(self) -> None:
        self.known = Numbers(_MEMO_BITS)
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.length, self.spelling = np.zeros(1 << 16, np.uint8), np.zeros((1 << 16, _MEMO_OCTETS), np.uint64)
        self.ids, self.n_ids = np.zeros(1 << 18, np.int32), 0

    def _find_direct(self) -> tuple[bool, bool] | None:
        """Whether a piece of letters goes to the model with its leading space, and in lower case, if that gives what encode gives."""
        want = [x.ids for x in self.tokenizer.encode_batch(_SAMPLES, add_special_tokens=False)]
        for space, lower in ((True, False), (False, True), (True, True), (False, False)):
            if [self._direct(x, space, lower) for x in _SAMPLES] == want:
                return space, lower
        return None

    def _direct(self, piece: str, space: bool, lower: bool) -> list[int]:
        """One word of letters, as the model sees it: its UTF-8 bytes, each as the character that stands for it."""
        piece = piece.lower() if lower else piece
        piece = piece if space else piece.lstrip(" ")
        return [x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_CHARS))]

    def _encoded(self, pieces: list[str], words: np.ndarray) -> list[list[int]]:
        """Ids of pieces; `words` marks those of one optional space and letters, which are one unit of the model each."""
        if self.direct is None:
            words = np.zeros(len(pieces), bool)
        out: list[list[int]] = [[]] * len(pieces)
        for i in np.flatnonzero(words).tolist():
            out[i] = self._direct(pieces[i], *self.direct)
        rest = np.flatnonzero(~words)
        for a in range(0, len(rest), _AT_ONCE):
            some = rest[a : a + _AT_ONCE].tolist()
            for i, x in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return out

    def _make_room(self, ids: int) -> None:
        while self.n_ids + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def _learn(self, hashes: np.ndarray, pieces: list[str], words: np.ndarray, length: np.ndarray, spelling: Octets) -> None:
        found = self._encoded(pieces, words)
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        n, m = self.known.n, len(found)
        while n + m > len(self.begin):
            self.begin, self.size, self.length, self.spelling = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.length, self.spelling))
        self._make_room(len(flat))
        self.begin[n : n + m] = self.n_ids + np.cumsum(size) - size
        self.size[n : n + m] = size
        self.length[n : n + m] = length
        self.spelling[n : n + m] = 0
        for k, (at, octet) in enumerate(spelling):
            self.spelling[n + (np.arange(m) if at is None else at), k] = octet
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)
        self.known.add(hashes)

    @staticmethod
    def _told(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Pieces as text, and which are one optional space and letters."""
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pieces, np.fromiter((_LETTERS(x) is not None for x in pieces), bool, len(pieces))

    def _same(self, length: np.ndarray, spelling: Octets, entry: np.ndarray) -> np.ndarray:
        """Has each piece the bytes of its entry?"""
        out = (self.length[entry] == length) & (self.spelling[entry, 0] == spelling[0][1])
        for k, (at, octet) in enumerate(spelling[1:], 1):
            out[at] &= self.spelling[entry[at], k] == octet
        return out

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ends of documents; each space or newline after visible ASCII or a letter from U+00C0 to U+00FF; each mark after a letter."""
        edge = np.zeros(len(data) + 1, bool)
        at = np.flatnonzero(self.cutters[data])
        at = at[at > 1]
        here, before = data[at], data[at - 1]
        latin = (before >= 0x80) & (data[at - 2] == 0xC3)
        after_letter = _ASCII_LETTERS[before] | latin & (before != 0x97) & (before != 0xB7)
        after_visible = (before > 0x20) & (before < 0x7F) | latin
        edge[at[np.where((here == 0x20) | (here == 0x0A), after_visible, after_letter)]] = True
        edge[offsets] = True
        return np.flatnonzero(edge)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(column)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        cuts = self._cuts(data, offsets)
        start, end = cuts[:-1], cuts[1:]
        length = end - start
        short = np.flatnonzero(length <= 8 * _MEMO_OCTETS)
        size = length[short]
        view = octets(data)
        spelling = span_octets(view, start[short], size, _MEMO_OCTETS)
        hashes = hash_octets(size, spelling)
        hashes[hashes == 0] = 1
        entry = self.known.find(hashes)
        new = np.flatnonzero(entry < 0)
        if self.known.n and self.known.n + len(new) > _MEMO_PIECES:
            self._clear()
            return self.encode(column)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._learn(distinct, *self._told(data, start[short[at]], start[short[at]] + size[at]), size[at], span_octets(view, start[short[at]], size[at], _MEMO_OCTETS))
            entry[new] = self.known.find(hashes[new])
        piece = np.full(len(start), -1, np.int32)
        piece[short] = np.where(self._same(size, spelling, entry), entry, -1)
        alone = np.flatnonzero(piece < 0)
        begin, size = self.begin[piece], self.size[piece]
        if len(alone):  # their ids lie behind the memo's until the next batch
            found = self._encoded(*self._told(data, start[alone], end[alone]))
            size[alone] = np.fromiter(map(len, found), np.int32, len(found))
            begin[alone] = self.n_ids + np.cumsum(size[alone]) - size[alone]
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(size[alone].sum()))
            self._make_room(len(flat))
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        ends = np.cumsum(size, dtype=np.int64)
        return self.ids[np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]))], np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, np.int32)
    last = bounds[1:] + np.arange(n)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[last] = end_id
    out[inside] = ids
    return out, bounds + np.arange(n + 1)


def write_shards(docs: DataFrame, definition: str, end_id: int, path: str, shard_bytes: int = 16 << 20) -> None:
    """Encodes docs by the tokenizer definition (its JSON) and writes shards and manifest below path."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(definition)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, place = MemoTokenizer.of(shared.value), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, most=_TEXT_BYTES):
            ids, bounds = with_end(*encoder.encode(batch.column("text")), end_id)
            size = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(size), shard, np.int32)),
                    pa.array(place + bounds[:-1]),
                    batch.column("doc_id"),
                    pa.array(size),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                ],
                ["shard", "place", "doc_id", "n_tokens", "ids"],
            )
            place += int(bounds[-1])
        release()

    total = text_bytes(docs)
    n = shares(total, max(shard_bytes, total // _MOST_SHARDS), spark.sparkContext.defaultParallelism)
    # A row's place in the input spreads equal rows; which of them is where makes no difference.
    placed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = placed.repartitionByRange(n, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "text")
    encoded = ordered.select("doc_id", "text").mapInArrow(run, f"shard int, place long, doc_id {kind}, n_tokens long, ids array<int>")
    encoded.write.options(**LAYOUT).parquet(f"{path}/shards")
    totals = spark.read.parquet(f"{path}/shards").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    totals.coalesce(1).write.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start: ids of all documents before it, n_tokens, ids). Columns that aren't used aren't read."""
    totals = sorted(map(tuple, spark.read.parquet(f"{path}/manifest").select("shard", "n_tokens").collect()))  # a row for each shard
    base = [0, *accumulate(n for _, n in totals)]
    bases = spark.createDataFrame([(shard, at) for (shard, _), at in zip(totals, base, strict=False)], "shard int, base long")
    return spark.read.parquet(f"{path}/shards").join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 bounds of a list column without nulls."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32: of the ids as little-endian unsigned 32-bit integers)."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = flat_ids(batch.column("ids"))
            raw, at = memoryview(ids.astype("<u4").tobytes()), (bounds * 4).tolist()
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op4_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    path = new_folder(spark, "tokens")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), definition, 0, path)
    return digests(read_shards(spark, path))
