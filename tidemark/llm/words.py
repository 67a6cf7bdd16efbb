"""Splitting texts into the words of a byte-level BPE, vectorised, and encoding single words."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Characters of a range that a worker splits at once.
CHARS = 1 << 21


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: its word rule, its merges and its pieces."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" \
                or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        # The library's own rule; its whole tokenizer would take a worker 27 MB that nothing uses.
        self.rule = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=spec["pre_tokenizer"].get("use_regex", True))
        letters = byte_letters()
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in self.added}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path} has merges out of the order of their ids")
        self.pieces = [b""] * (1 + max([*ranks.values(), *self.added.values()]))
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+|\s+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self.kinds = np.zeros(0x110000, np.uint8)

    def encode_word(self, word: str) -> list[int]:
        special = self.added.get(word)
        return self.merge(word.encode()) if special is None else [special]

    def kinds_of(self, codes: np.ndarray) -> np.ndarray:
        """Letter, number, space or other; characters not met before are put to the library's own rule."""
        kinds = self.kinds[codes]
        if not kinds.all():
            rule = self.rule.pre_tokenize_str
            for code in np.unique(codes[kinds == 0]):
                alone = [k for k, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(rule(lead + chr(code))) == 1]
                self.kinds[code] = alone[0] if alone else SPACE
            kinds = self.kinds[codes]
        return kinds

    def split(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """All words of the texts in order, and the number of words of each text.

        The rule is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|space run but its last|space run.
        """
        segments, special, first = texts, [], None
        if self.cuts and any(a in t for a in self.added for t in texts):
            parts = [[s for s in self.cuts.split(t) if s] for t in texts]
            segments = [s for p in parts for s in p]
            special = [i for i, s in enumerate(segments) if s in self.added]
            first = np.cumsum([0] + [len(p) for p in parts])
        joined = "".join(segments)
        bounds = np.zeros(len(segments) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)), out=bounds[1:])
        n = len(joined)
        if n == 0:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds_of(codes)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        start = edge[:n] | np.concatenate(([True], kinds[1:] != kinds[:-1]))
        after = np.flatnonzero(start[1:] & ~edge[1:n] & (kinds[:-1] == SPACE)) + 1  # a run that follows white space
        start[after - 1] = True
        start[after[codes[after - 1] == 32]] = False
        self._contractions(codes, kinds, edge, start)
        for i in special:
            start[bounds[i] + 1:bounds[i + 1]] = False
        begins = np.flatnonzero(start)
        width = np.ones(n, np.int8)
        if not joined.isascii():
            width += codes > 0x7F
            width += codes > 0x7FF
            width += codes > 0xFFFF
        offsets = np.zeros(len(begins) + 1, np.int32)
        np.cumsum(np.add.reduceat(width, begins, dtype=np.int32), out=offsets[1:])
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(joined.encode()))
        at = np.searchsorted(begins, bounds if first is None else bounds[first])
        return words, np.diff(at)

    @staticmethod
    def _contractions(codes, kinds, edge, start) -> None:
        """An apostrophe that begins a word takes the s, t, re, ve, m, ll or d behind it; the rest begins anew."""
        n = len(codes)
        for q in np.flatnonzero(start & (codes == 39)):
            if q + 1 >= n or edge[q + 1] or kinds[q + 1] != LETTER:
                continue
            one = chr(codes[q + 1])
            two = one + chr(codes[q + 2]) if q + 2 < n and not edge[q + 2] else ""
            took = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if took:
                start[q + 1] = False
                if q + 1 + took < n:
                    start[q + 1 + took] = True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo:
    """Ids of words as the bytes of 32-bit numbers, kept while they fit; beyond `limit` words it starts anew."""

    def __init__(self, vocab: Vocabulary, limit: int = 1 << 16):
        self.vocab, self.limit, self.known = vocab, limit, {}

    def ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        out, known, encode = [], self.known, self.vocab.encode_word
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = array("i", encode(w)).tobytes()
            out.append(ids)
        return out
