"""Packing by powers of two: each document is cut into binary-length pieces, each piece a sequence of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ragged, slices, texts_of
from tidemark.llm.words import Memo, vocabulary

#: Characters of a slice that a worker encodes at once.
CHARS = 1 << 20
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids array<int>")


def lengths_of(n: int, most: int) -> list[int]:
    """`most` as often as it fits, then the binary digits of what is left, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def encoded(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the number of ids of each."""
    words, counts = memo.vocab.split(texts)
    coded = words.dictionary_encode()
    known = memo.ids(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    flat = np.frombuffer(b"".join(known), np.int32)
    codes = coded.indices.to_numpy()
    of_word = size[codes]
    ids = flat[ragged((np.cumsum(size) - size)[codes], of_word)]
    ends = np.concatenate(([0], np.cumsum(of_word)))
    at = np.concatenate(([0], np.cumsum(counts)))
    return ids, np.diff(ends[at])


def pack(docs: DataFrame, vocab_path: str, most: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece with its ids; a piece is a sequence, so none crosses documents and none is padded.

    A document is its ids and then `end_id`, so a null or empty text is one piece of length 1. Pieces of one length
    share a `bucket` (the power); `write_buckets` lays them out by it. Repeated rows are packed once each, a null
    doc_id stays null, columns besides doc_id and text are not read. `most` must be a power of two. Nothing is
    shuffled: a sequence's number is the task and the place in it.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(vocabulary(vocab_path))
        for batch in batches:
            for part in slices(batch, CHARS):
                yield pieces(part.column("doc_id"), *encoded(texts_of(part), memo))

    def pieces(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
        counts = counts + 1
        cut = [lengths_of(int(n), most) for n in counts]
        length = np.fromiter((x for c in cut for x in c), np.int64)
        of = np.repeat(np.arange(len(counts)), [len(c) for c in cut])
        ends = np.cumsum(length)
        begins = ends - length
        raw = memoryview(ids.astype("<u4")).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins, ends)), np.int64, len(length))
        doc_start = np.cumsum(counts) - counts
        listed = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]).astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(of)), pa.array(begins - doc_start[of]), pa.array(length), pa.array(crc),
             pa.array(counts[of]), pa.array(np.round(np.log2(length)).astype(np.int32)), listed],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"])

    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as files by length, so that a batch of one bucket needs no padding."""
    packed.write.partitionBy("bucket").parquet(path)
