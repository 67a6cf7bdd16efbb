"""Packing and BPE against the tokenizers library."""

import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, lines, packing, words
from tidemark.llm.common import by_size, slices, texts_of
from tidemark.llm.queries import VOCAB

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PARTS = ["'", "s", "t", "re", "ll", "d", "ve", " ", "  ", "\n", "\t", " ", "a", "B", "é", "1", "٣", "!", "--",
         "<|endoftext|>", "日本", "😀", " ", "\r\n", "'ll", "\x1c", "\x85", "ſ", "²", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def mixed(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


def test_words_follow_the_library(library):
    vocab = words.vocabulary(VOCAB)
    texts = mixed(3000) + ["", "'s", "a's", " 's", "\n's", "''s"]
    split, counts = vocab.split(texts)
    split, at = split.to_pylist(), 0
    for text, n in zip(texts, counts):
        assert [i for w in split[at:at + n] for i in vocab.encode_word(w)] == \
            library.encode(text, add_special_tokens=False).ids
        at += n


DOCS = [(1, "Hello there, it's fine"), (2, None), (3, ""), (3, "twice"), (3, "twice"), (None, "no id"),
        (4, "word " * 5000), (5, "<|endoftext|> tail"), *[(10 + i, t) for i, t in enumerate(mixed(40))]]


def test_encode_and_decode(frame, library):
    rows = bpe.encode_digests(frame(DOCS), VOCAB, block_chars=2000).collect()

    def expected(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), \
            hashlib.sha256(text.encode()).hexdigest()

    assert sorted(map(str, map(tuple, rows))) == sorted(str(expected(i, t)) for i, t in DOCS)


def test_ids_round_trip(frame, library):
    rows = bpe.decode(bpe.encode(frame(DOCS), VOCAB), VOCAB).collect()
    assert sorted(r.decoded for r in rows) == sorted(t or "" for _, t in DOCS)


def test_packing_cuts_every_id_once(frame, library):
    rows = packing.pack(frame(DOCS), VOCAB, most=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.bucket == r.length.bit_length() - 1 for r in rows)
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in DOCS if i not in (3, None)}
    for i, ids in whole.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
            assert p.doc_tokens == len(ids)
    assert sorted(r.doc_tokens for r in rows if r.doc_id == 3 and r.start == 0) == sorted(
        len(library.encode(t, add_special_tokens=False).ids) + 1 for t in ("", "twice", "twice"))


def test_empty_tables(frame):
    assert packing.pack(frame([]), VOCAB).count() == 0
    assert bpe.encode_digests(frame([]), VOCAB).count() == 0


def test_longest_piece_must_be_a_power(frame):
    with pytest.raises(ValueError):
        packing.pack(frame([]), VOCAB, most=100)


def test_slices_hold_every_row_once():
    texts = [None, "", "ab", "é" * 9, "c", None, "dd", "x" * 30, "", "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(slices(batch, 10))
    assert [x for p in parts for x in p.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert [texts_of(p) for p in parts] == [texts_of(batch)[a:b] for a, b in by_size(texts_of(batch), 10)]
    assert not list(slices(batch.slice(0, 0), 10))


def test_a_worker_keeps_little():
    """200,000 distinct words and 2 million characters at once, within a few MB beside the words themselves."""
    memo = words.Memo(words.vocabulary(VOCAB))
    whole = memo.ids(["first"])
    text = "some words of a line 12\n" * (lines.CHARS // 24)
    lines.kinds()
    tracemalloc.start()
    try:
        for a in range(0, 200_000, 5000):
            memo.ids([f" w{i}" for i in range(a, a + 5000)])
        kept = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        lines.Parsed([text])
        parsed = tracemalloc.get_traced_memory()[1] - kept
    finally:
        tracemalloc.stop()
    assert memo.ids(["first"]) == whole
    assert kept < 20e6 and parsed < 70e6
