"""SentencePiece (BPE models): a table of each prefix's last piece, filled from automaton matches, read backwards."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_size, ragged, texts_of

#: Characters of a range of documents whose distinct words a worker encodes at once.
CHARS = 1 << 22
#: Longer words fill their table alone, one character after the other.
LONG = 64
#: Places for answers about pairs of pieces that a worker remembers, a power of two; a new pair takes its place over.
PAIRS = 1 << 20
#: Distinct words that a worker remembers; beyond, it forgets all and goes on.
WORDS = 1 << 19
SPACE, BETWEEN = "▁", "\0"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
OUTSIDE = -1
NEVER = float("inf")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """A BPE model file of the sentencepiece library: pieces, their order of merging, and how two pieces may meet.

    Taken are models whose text is only changed by the space mark and its dummy at the front, whose pieces bear the mark
    in front or are runs of it, and whose scores differ but for those runs, which merge last. Others raise ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, np.array([p.type for p in model.pieces])
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix \
                or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix \
                or not norm.escape_whitespaces or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} isn't a BPE model that leaves texts as they are")
        self.text = {i: p.piece for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.ids = {t: i for i, t in self.text.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        runs = {len(t): i for t, i in self.ids.items() if set(t) == {SPACE}}
        words = {t: i for t, i in self.ids.items() if set(t) != {SPACE}}
        scores = [model.pieces[i].score for t, i in words.items() if len(t) > 1]
        last = [model.pieces[i].score for n, i in runs.items() if n > 1]
        most = max(runs, default=0)
        in_order = all(merged_run(n, runs) == [most] + merged_run(n - most, runs) for n in range(most, 3 * most))
        if len(self.bytes) != 256 or 1 not in runs or not in_order or len(set(scores)) != len(scores) or len(set(last)) > 1 or last and max(last) >= min(scores) \
                or any(SPACE in t[1:] or BETWEEN in t for t in words) or any(c not in self.ids for t in words for c in t):
            raise ValueError(f"{path} has pieces whose order of merging doesn't follow from their ids alone")
        self.most = most
        self.rests = np.full((most + 1, most), OUTSIDE, np.int32)  # [marks left, place]: the piece that begins there
        for n in range(1, most + 1):
            lengths = merged_run(n, runs)
            self.rests[n, np.cumsum([0] + lengths[:-1])] = [runs[k] for k in lengths]
        self.space = runs[1]
        self.lines = not any("\n" in t for t in words)
        order = sorted((t for t in words if len(t) > 1), key=lambda t: -model.pieces[words[t]].score)
        self.rank = {t: n for n, t in enumerate(order)}
        self.matches = ahocorasick.Automaton()
        self.single = np.full(0x110000, OUTSIDE, np.int32)
        for t, i in [*words.items(), (SPACE, self.space)]:
            if len(t) > 1:
                self.matches.add_word(t, i)
            else:
                self.single[ord(t)] = i
        self.matches.make_automaton()
        self.length = np.array([len(self.text.get(i, " ")) for i in range(len(kinds))], np.int32)
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.edges: dict[int, tuple] = {}
        self.forget()
        self.asked, self.answers = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        surface = {UNKNOWN: model.trainer_spec.unk_surface, CONTROL: ""}
        spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
                   else (surface[p.type] if p.type in surface else p.piece.replace(SPACE, " ")).encode()
                   for p in model.pieces]
        self.silent = kinds == CONTROL
        self.leads = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.spelled, self.decimal = Strings(spelled), Strings([b"%d," % i for i in range(len(spelled))])

    def ends(self, piece: int) -> tuple[list, list, bool]:
        """The symbols at a piece's left and right end while it is merged: (text, rank of the merge that takes it in).

        Last, whether the merges of its text do end in the piece; one that they never reach is never used.
        """
        found = self.edges.get(piece)
        if found is None:
            parts = list(self.text[piece])
            left, right = [parts[0]], [parts[-1]]
            took: list[list[int]] = [[], []]
            reached = True
            while len(parts) > 1:
                rank, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER or any(rank < r for r in took[0] + took[1]):
                    reached = False
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    left.append(parts[0])
                    took[0].append(rank)
                if at == len(parts) - 1:
                    right.append(parts[-1])
                    took[1].append(rank)
            found = self.edges[piece] = (list(zip(left, [*took[0], NEVER])), list(zip(right, [*took[1], NEVER])), reached)
        return found

    def may_meet(self, one: int, two: int) -> bool:
        """Whether the text of two pieces, merged as a whole, becomes these two: no merge across comes first.

        Both sides merge on their own until a symbol at the right end of the first and one at the left end of the second
        make a piece that ranks before whatever would take either of them in; of equal ranks the left one goes first.
        At the front, or behind a character that no piece holds, any piece may stand that merges reach at all.
        """
        lefts, _, reached = self.ends(two)
        if one == OUTSIDE or not reached:
            return reached
        rights, i, j = self.ends(one)[1], 0, 0
        while True:
            (a, until_a), (b, until_b) = rights[i], lefts[j]
            across = self.rank.get(a + b, NEVER)
            if across < until_a and across <= until_b:
                return False
            if until_a == until_b == NEVER:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def meet(self, ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
        """`may_meet` for many pairs; answers are kept in a table of fixed size."""
        n = len(self.length) + 1
        pair = (ones.astype(np.int64) + 1) * n + twos
        place = (pair * 0x9E3779B97F4A7C1 >> 20) & (PAIRS - 1)
        fits = self.answers[place]
        new = np.flatnonzero(self.asked[place] != pair)
        if len(new):
            asked, which = np.unique(pair[new], return_inverse=True)
            fits[new] = np.fromiter((self.may_meet(p // n - 1, p % n) for p in asked.tolist()), bool, len(asked))[which]
            self.answers[place[new]], self.asked[place[new]] = fits[new], pair[new]
        return fits

    def last_pieces(self, words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All words in one string, where they begin in it, and the table: for each place the piece that ends there.

        That is the one last piece of the encoding of the word's characters up to there. Any piece that the automaton
        finds to end there is it if it may meet the last piece of what is before it. Words grow side by side.
        """
        joined = BETWEEN.join([*words, ""])
        begins = np.cumsum([0] + [len(w) + 1 for w in words])
        found = np.fromiter(chain.from_iterable(self.matches.iter(joined)), np.int64).reshape(-1, 2)
        alone = self.single[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        known = np.flatnonzero(alone != OUTSIDE)
        end, piece = np.concatenate((found[:, 0], known)) + 1, np.concatenate((found[:, 1], alone[known]))
        begin = end - self.length[piece]
        last = np.full(len(joined) + 1, OUTSIDE, np.int32)
        word = np.searchsorted(begins, begin, "right") - 1
        place, long = end - begins[word], np.diff(begins)[word] > LONG + 1
        short = np.flatnonzero(~long)
        short = short[np.argsort(place[short], kind="stable")]
        for at in np.split(short, np.cumsum(np.bincount(place[short]))[:-1]):
            if len(at):
                fits = at[self.meet(last[begin[at]], piece[at])]
                last[end[fits]] = piece[fits]
        table, remembered = last.data, {}
        rows = np.flatnonzero(long)
        rows = rows[np.lexsort((begin[rows], end[rows]))]
        for b, e, p in zip(*(x[rows].tolist() for x in (begin, end, piece))):
            if table[e] == OUTSIDE:
                pair = table[b], p
                fits = remembered.get(pair)
                if fits is None:
                    if len(remembered) >= PAIRS:
                        remembered.clear()
                    fits = remembered[pair] = self.may_meet(*pair)
                if fits:
                    table[e] = p
        return joined, begins, last

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each: read backwards from the words' ends."""
        joined, begins, last = self.last_pieces(words)
        cut = np.zeros(len(joined) + 1, bool)
        at, first = begins[1:] - 1, begins[:-1]
        while len(at):
            more = at > first
            at, first = at[more], first[more]
            cut[at] = True
            at = at - np.where(last[at] == OUTSIDE, 1, self.length[last[at]])
        at = np.flatnonzero(cut)
        ids, size = last[at], np.ones(len(at), np.int64)
        outside = np.flatnonzero(ids == OUTSIDE)
        strange = [joined[i].encode() for i in (at[outside] - 1).tolist()]
        size[outside] = list(map(len, strange))
        ids = np.repeat(ids, size)
        ids[ids == OUTSIDE] = self.byte_ids[np.frombuffer(b"".join(strange), np.uint8)]
        ends = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(ends[np.searchsorted(at, begins, "right")])

    def words(self, text: str) -> list[str]:
        """The parts between which no piece reaches, without their space mark; a part that begins a line has none."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        return (text.replace("\n", " \n") if self.lines else text).split(" ")

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.firsts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """The numbers of words among those known; what is new is encoded."""
        if len(self.known) + len(words) > WORDS:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            flat, sizes = self.encode_words([w if self.lines and w[:1] == "\n" else SPACE + w for w in new])
            self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each; each distinct word is encoded once."""
        split = [self.words(t) for t in texts]
        coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())
        size, codes = self.sizes[place], coded.indices.to_numpy()
        begin = self.firsts[place]
        of_word = size[codes]
        ids = self.flat[ragged(begin[codes], of_word)]
        ends = np.concatenate(([0], np.cumsum(of_word)))
        at = ends[np.cumsum([0] + [len(words) for words in split])]
        return self.merge_spaces(ids, at)

    def merge_spaces(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Space marks left alone merge last and from the left: each run becomes the longest pieces there are."""
        lone = ids == self.space
        begin = lone.copy()
        begin[1:] &= ~lone[:-1]
        begin[at[:-1][np.diff(at) > 0]] |= lone[at[:-1][np.diff(at) > 0]]
        marks = np.flatnonzero(lone)
        firsts = np.flatnonzero(begin[marks])
        length = np.diff(np.append(firsts, len(marks)))
        place = np.arange(len(marks)) - np.repeat(firsts, length)
        whole = np.repeat(length, length)
        left = np.minimum(self.most, whole - place // self.most * self.most)
        pieces = self.rests[left, place % self.most]
        ids[marks] = pieces
        kept = np.ones(len(ids), bool)
        kept[marks] = pieces != OUTSIDE
        return ids[kept], np.diff(np.concatenate(([0], np.cumsum(kept)))[at])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: without the mark that the encoder put in front, each byte that is no UTF-8 as U+FFFD."""
        parts = np.split(ids, np.flatnonzero(self.silent[ids]))  # a control id parts the bytes around it
        spoken = np.flatnonzero(~self.silent[ids])
        text = "".join([self.spelled.joined(x).decode("utf-8", "each_byte") for x in parts])
        return text[int(len(spoken) > 0 and self.leads[ids[spoken[0]]]):]


def merged_run(n: int, runs: dict[int, int]) -> list[int]:
    """Lengths of the pieces that a run of n space marks becomes: all rank alike, so the leftmost two merge that can."""
    parts = [1] * n
    at = 0
    while at + 1 < len(parts):
        if parts[at] + parts[at + 1] in runs:
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            at = max(at - 1, 0)
        else:
            at += 1
    return parts


class Strings:
    """Byte strings that are looked up by number and joined."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        return self.bytes[ragged(self.begin[numbers], self.size[numbers])].tobytes()


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, model_path: str, schema: str, finish) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = texts_of(batch)
            for begin, end in by_size(texts, CHARS):
                ids, counts = model.encode(texts[begin:end])
                yield finish(model, batch.column("doc_id").slice(begin, end - begin), np.split(ids, np.cumsum(counts)[:-1]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (decimal, joined by commas) and of the text that they decode to.

    A null or empty text has no ids and decodes to nothing. Texts of any length are encoded whole, in time that grows
    with their length. Repeated rows and null ids are kept as they are; columns besides doc_id and text are not read.
    Nothing is shuffled; a task remembers a bounded number of words and pairs.
    """

    def finish(model, doc_ids, ids) -> pa.RecordBatch:
        lists = [hashlib.sha256(model.decimal.joined(x)[:-1]).hexdigest() for x in ids]
        texts = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids]
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array(lists, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, model_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids, one row per document, by the same way as `encode_digests`."""

    def finish(model, doc_ids, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encoded(docs, model_path, "doc_id long, ids array<int>", finish)


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """`tokens` (doc_id, ids) with a column `decoded`; null ids decode to the empty text, unknown ids are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                                             ["doc_id", "ids", "decoded"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")) \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded string")
