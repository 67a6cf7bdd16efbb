"""SentencePiece ids and texts against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.queries import PIECES

PARTS = [" ", "  ", "\n", "\t", "▁", "a", "the", "ing", "é", "日本", "😀", "\x00", "<s>", "<0x0A>", "�", "1", "23", " " * 17,
         "ſ", "नम", "\r", "er", "tion", ".", "x" * 70]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def mixed(n, parts=PARTS, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(n)]


def test_ids_follow_the_library(library):
    model = pieces.PieceModel(PIECES)
    texts = mixed(3000) + mixed(3000, " etaoinshrdlu\n") + mixed(2000, sorted(model.ids)) + [" " * n for n in range(70)]
    ids, counts = model.encode(texts)
    for text, x in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert x.tolist() == library.encode(text)
        assert model.decode(x) == library.decode(x.tolist())


def test_any_ids_decode_as_in_the_library(library):
    model, rng = pieces.piece_model(PIECES), random.Random(1)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < .5 else rng.randrange(300) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_a_pair_meets_only_if_its_text_becomes_the_pair(library):
    model, rng = pieces.piece_model(PIECES), random.Random(2)
    words = [i for t, i in model.ids.items() if "▁" not in t]
    pairs = np.array([(rng.choice(words[:3000]), rng.choice(words[:3000])) for _ in range(20000)])
    fits = model.meet(pairs[:, 0], pairs[:, 1])
    for (a, b), fit in zip(pairs.tolist(), fits):
        text = "\n" + model.text[a] + model.text[b]  # a line feed is no piece, so the pair stands alone behind it
        assert fit == (library.encode(text)[2:] == [a, b])


DOCS = [(1, "Hello there, it's fine"), (2, None), (3, ""), (3, "twice"), (3, "twice"), (None, "no id"), (4, "word " * 5000),
        (5, "x" * 30000), (6, "日本語" * 4000), (7, " " * 999), *[(10 + i, t) for i, t in enumerate(mixed(40))]]


def test_encode_and_decode(frame, library):
    rows = pieces.encode_digests(frame(DOCS), PIECES).collect()

    def expected(i, t):
        ids = library.encode(t or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), \
            hashlib.sha256(library.decode(ids).encode()).hexdigest()

    assert sorted(map(str, map(tuple, rows))) == sorted(str(expected(i, t)) for i, t in DOCS)


def test_ids_round_trip(frame):
    rows = pieces.decode(pieces.encode(frame(DOCS), PIECES), PIECES).collect()
    assert sorted(r.decoded for r in rows) == sorted((t or "").replace("▁", " ") for _, t in DOCS)


def test_words_are_forgotten_in_time(library):
    model = pieces.PieceModel(PIECES)
    model.known = {f"old{i}": 0 for i in range(pieces.WORDS)}
    ids, counts = model.encode(["some new words", "words"])
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode("some new words")
    assert len(model.known) == 3


def test_empty_table(frame):
    assert pieces.encode_digests(frame([]), PIECES).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(tmp_path / "m"))
