"""Concatenate and cut: all documents' ids, in ascending doc_id order, as one stream cut into windows of `length` ids.

Two passes give global offsets: the shards written by siltbed.llm.tokens carry each document's place in its shard, and
prefix sums over the shards' totals give each shard's start. Windows are then fixed by arithmetic: id number g of the
stream lies in sequence g // length at offset g % length. A document that crosses a window's end is cut there, and each
piece is a boundary record. Every sequence but the last is full; the last is padded to a power of two from its ids on, so
padding is under `length` ids in all.

How it scales: one range shuffle of the texts (in the shard writer); the cutting streams over the shards.

Cases: a null or empty text is its end id alone, a text longer than a window makes as many pieces as it needs; rows that
share a doc_id are packed each, null doc_ids first. Other columns are ignored; no documents give no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltbed.llm.tokens import crc, flat_ids, read_shards, write_shards
from siltbed.sources.folders import new_folder

LENGTH, END_ID = 4096, 2


def padded_length(ids: int, length: int = LENGTH) -> int:
    """What a sequence of so many ids is padded to: the least power of two that holds them, `length` at most."""
    return min(length, 1 << max(0, ids - 1).bit_length())


def cut(tokens: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start in the document, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for)."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = flat_ids(batch.column("ids"))
            begin = batch.column("start").to_numpy(zero_copy_only=False)
            size = np.diff(bounds)
            first = begin // length
            count = np.where(size > 0, (begin + size - 1) // length - first + 1, 0)
            row = np.repeat(np.arange(len(size)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(sequence * length, begin[row])
            high = np.minimum((sequence + 1) * length, (begin + size)[row])
            at = bounds[row] + low - begin[row]
            sums = [crc(ids[a:b]) for a, b in zip(at.tolist(), (at + high - low).tolist(), strict=True)]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "start": pa.array(low - begin[row]),
                "length": pa.array(high - low),
                "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": pa.array(size[row]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(low - sequence * length),
            }
            if with_ids:  # pieces of a batch follow one another without gaps
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(ids)]]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, definition: str, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Encodes docs once (see siltbed.llm.tokens) and cuts them into pieces."""
    spark = docs.sparkSession
    path = new_folder(spark, "packing")
    write_shards(docs, definition, end_id, path)
    return cut(read_shards(spark, path), length, with_ids)


def word_vocabulary(path: str | None = None) -> str:
    """The definition of the tokenizer of this operator's query."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary(vocabulary), with_ids=False)
