"""BPE by a table of distinct words: each word is encoded once and its ids are joined back by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_size, ragged, shuffle_partitions, texts_of
from tidemark.llm.words import CHARS, vocabulary

#: Characters of a block; a longer text is a block of its own. Larger blocks name fewer words twice.
BLOCK_CHARS = 32_000_000
#: Blocks that one task may number.
BLOCKS = 1 << 8
BLOCK_SCHEMA = "block long, doc_ids array<long>, n_words array<int>, codes binary, words binary"
RESULT_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKEN_SCHEMA = "doc_id long, ids array<int>, decoded string"


def word_blocks(docs: DataFrame, vocab_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of documents: their ids, their numbers of words, all words as positions in a list, the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, pack = vocabulary(vocab_path), zstandard.ZstdCompressor(level=6).compress
        block = TaskContext.get().partitionId() * BLOCKS
        known: dict[str, int] = {}
        ids, counts, codes, chars = [], [], [], 0

        def row() -> pa.RecordBatch:
            numbers = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            rank = np.empty(len(known), np.int32)  # frequent words get small numbers, which pack better
            rank[np.argsort(-np.bincount(numbers, minlength=len(known)), kind="stable")] = np.arange(len(known))
            numbers = rank[numbers] if len(known) else numbers
            words = pa.array(list(known), pa.string())
            order = pc.sort_indices(words)
            words = words.take(order)  # in order neighbours share their beginnings
            sizes = pc.binary_length(words).to_numpy().astype(np.int32)
            listed = np.int32(len(known)).tobytes() + planes(sizes) + planes(rank[order.to_numpy()]) \
                + (words.buffers()[2].to_pybytes()[:int(sizes.sum())] if len(known) else b"")
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([np.concatenate(counts)], pa.list_(pa.int32())),
                 pa.array([pack(planes(numbers))]), pa.array([pack(listed)])],
                ["block", "doc_ids", "n_words", "codes", "words"])

        for batch in batches:
            texts = texts_of(batch)
            doc_ids = batch.column("doc_id").to_pylist()
            for begin, end in by_size(texts, CHARS):
                words, n = vocab.split(texts[begin:end])
                coded = words.dictionary_encode()
                place = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()),
                                    np.int32, len(coded.dictionary))
                codes.append(place[coded.indices.to_numpy()])
                ids += doc_ids[begin:end]
                counts.append(n.astype(np.int32))
                chars += sum(map(len, texts[begin:end]))
                if chars >= block_chars:
                    yield row()
                    block += 1
                    if block % BLOCKS == 0:
                        raise ValueError(f"a task has more than {BLOCKS} blocks of {block_chars} characters")
                    known, ids, counts, codes, chars = {}, [], [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK_SCHEMA)


def planes(numbers: np.ndarray) -> bytes:
    """Low bytes, then the next: they compress better apart."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def listed_words(blocks: DataFrame) -> DataFrame:
    """at, word: the words of each block's list; `at` is the block in its upper half and the word's number below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                raw = unpack(packed)
                n = int(np.frombuffer(raw, np.int32, 1)[0])
                offsets = np.concatenate(([0], np.cumsum(unplaned(raw[4:4 + 4 * n])))).astype(np.int32)
                place = unplaned(raw[4 + 4 * n:4 + 8 * n]).astype(np.int32)
                words = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 8 * n:]))
                for at in range(0, n, 65536):
                    part = words.slice(at, 65536)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((block << 32) + place[at:at + 65536].astype(np.int64)), part], ["at", "word"])

    return blocks.mapInArrow(run, "at long, word string")


def encoded_words(listed: DataFrame, vocab_path: str) -> DataFrame:
    """block, place, ids (bytes): rows come sorted by word, so each distinct word is encoded once, in bounded memory."""
    n = shuffle_partitions(listed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        last, last_ids, width = None, b"", width_of(vocab)
        for batch in batches:
            runs = pc.run_end_encode(batch.column("word"))
            distinct = runs.values.to_pylist()
            ids = [last_ids if w == last else np.array(vocab.encode_word(w), width).tobytes() for w in distinct]
            if distinct:
                last, last_ids = distinct[-1], ids[-1]
            ends, at = runs.run_ends.to_numpy(), batch.column("at").to_numpy()
            of_row = np.repeat(np.arange(len(distinct)), np.diff(np.concatenate(([0], ends))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 32), pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(ids, pa.binary()).take(pa.array(of_row))],
                ["block", "place", "ids"])

    return listed.repartition(n, "word").sortWithinPartitions("word").mapInArrow(run, "block long, place int, ids binary")


def width_of(vocab) -> str:
    """The narrowest number that holds every id."""
    return "<u2" if len(vocab.pieces) <= 1 << 16 else "<u4"


def joined_back(docs: DataFrame, vocab_path: str, block_chars: int, schema: str, finish) -> DataFrame:
    n = shuffle_partitions(docs.sparkSession)
    blocks = word_blocks(docs, vocab_path, block_chars).repartition(n, "block")
    ids = encoded_words(listed_words(blocks), vocab_path)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack, width = zstandard.ZstdDecompressor().decompress, np.dtype(width_of(vocabulary(vocab_path)))
        right = right.combine_chunks()
        place = right.column("place").to_numpy()
        raw = right.column("ids").combine_chunks() if right.num_rows else pa.array([], pa.binary())
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        edges = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset) // width.itemsize \
            if len(raw) else np.zeros(1, int)
        whole = raw.buffers()[2] if len(raw) else None
        flat = np.frombuffer(whole, width, whole.size // width.itemsize) if whole else np.zeros(0, width)
        size, begin = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        size[place], begin[place] = np.diff(edges), edges[:-1]
        rows = []
        for r in range(left.num_rows):
            doc_ids = left.column("doc_ids")[r].as_py()
            counts = left.column("n_words")[r].values.to_numpy()
            codes = unplaned(unpack(left.column("codes")[r].as_py()))
            at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            for i, doc_id in enumerate(doc_ids):
                words = codes[at[i]:at[i + 1]]
                rows.append((doc_id, flat[ragged(begin[words], size[words])].astype("<u4")))
        return finish(rows)

    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, schema)


class Pieces:
    """The id-to-piece table: ids are joined with it by position in an array, bounded by the vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes[ragged(self.begin[ids], self.size[ids])].tobytes().decode("utf-8", "replace")


def encode_digests(docs: DataFrame, vocab_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the text that they decode to.

    A null or empty text has no ids and decodes to nothing. Repeated rows and null ids are kept as they are; other
    columns are not read. Words are listed per block of documents, so the word table is built from some words per
    block instead of each occurrence, and the texts themselves are not shuffled, only compressed word numbers.
    """

    def finish(rows) -> pa.Table:
        pieces = Pieces(vocabulary(vocab_path).pieces)
        return pa.table({
            "doc_id": pa.array([d for d, _ in rows], pa.int64()),
            "n_tokens": pa.array([len(x) for _, x in rows], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for _, x in rows], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(pieces.decode(x).encode()).hexdigest() for _, x in rows],
                                       pa.string())})

    return joined_back(docs, vocab_path, block_chars, RESULT_SCHEMA, finish)


def encode(docs: DataFrame, vocab_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids, one row per document, by the same way as `encode_digests`."""

    def finish(rows) -> pa.Table:
        return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()),
                         "ids": pa.array([x.astype(np.int32) for _, x in rows], pa.list_(pa.int32()))})

    return joined_back(docs, vocab_path, block_chars, "doc_id long, ids array<int>", finish)


def decode(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """`tokens` (doc_id, ids) with a column `decoded`; null ids decode to the empty text, unknown ids are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary(vocab_path).pieces)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            decoded = [pieces.decode(np.array(x or [], np.int64)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(decoded, pa.string())],
                                             ["doc_id", "ids", "decoded"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, TOKEN_SCHEMA)
