"""Line dedup by a tree of log templates: lines are parsed to templates, and templates that recur are dropped."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ragged, shuffle_partitions, slices, texts_of
from tidemark.session import write_through

#: Lines with fewer tokens have nothing that may vary.
LEAST_TOKENS = 5
#: Tokens that lead to a leaf, beside their number; one tree takes them from the front, one from the end.
DEPTH = 2
#: Share of the tokens, in hundredths, in which two templates of a leaf are alike.
SHARE = 80
#: Distinct templates of a leaf that are compared at once; a larger leaf is dealt to cells of two such parts each.
PART = 2048
#: Characters of a range of documents that a worker parses at once.
CHARS = 1 << 21
#: Tokens of a range that are hashed at once.
TOKENS = 1 << 14
#: Scripts written without spaces (Thai to Burmese, Khmer, kana, Han): each character is a token.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
            (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
SPACE, ALONE, DIGIT = 1, 2, 4
FIELD = np.uint64(0)
NO_ID = (1 << 63) - 1
KEYS = "key long, leaf boolean, owner long, last long"
TEMPLATES = "h long, head long, tail long, codes binary, owner long"
LINES = "id long, text_hash long, line int, h long, again boolean"


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    table[[c for c in range(0x3001) if chr(c).isspace()]] = SPACE
    for a, b in UNSPACED:
        table[a:b + 1] |= ALONE
    table[[c for c in range(sys.maxunicode + 1) if chr(c).isdecimal()]] |= DIGIT
    return table


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A number that depends on all bits of x; different salts give unrelated ones."""
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Parsed:
    """All lines of some texts that hold a token, in order; each token is a number, tokens with digits are FIELD.

    Where fields are the greater part of a line, what varies is all it says, and its tokens stand for themselves.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[codes]
        space = kind & SPACE > 0
        start = ~space
        start[1:] &= space[:-1] | (kind[1:] & ALONE > 0) | (kind[:-1] & ALONE > 0)
        chars = np.flatnonzero(~space)
        begin = np.flatnonzero(start[chars])
        edges = np.append(begin, len(chars))
        raw, field = np.zeros(len(begin), np.uint64), np.zeros(len(begin), bool)
        for a in range(0, len(begin), TOKENS):
            cut = edges[a:a + TOKENS + 1]
            at, first, size = chars[cut[0]:cut[-1]], cut[:-1] - cut[0], np.diff(cut)
            value = codes[at].astype(np.uint64) << np.uint64(32)
            value += (np.arange(len(at)) - np.repeat(first, size)).astype(np.uint64)
            raw[a:a + TOKENS] = mixed(np.add.reduceat(mixed(value, 1), first) + size.astype(np.uint64), 2)
            field[a:a + TOKENS] = np.bitwise_or.reduceat(kind[at], first) & DIGIT > 0
        ends = np.flatnonzero(codes == 10)
        line = np.searchsorted(ends, chars[begin])
        del joined, codes, kind, space, start, chars, begin  # what follows is by token
        self.line, first, self.n = np.unique(line, return_index=True, return_counts=True)
        self.begin = first
        of = np.repeat(np.arange(len(first)), self.n)
        fields = np.bincount(of, field, len(first))
        self.tokens = np.where(field & (2 * fields <= self.n)[of], FIELD, raw)
        per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
        ends_of = np.cumsum(per_text)
        self.text = np.searchsorted(ends_of, self.line, "right")
        self.number = self.line - (ends_of - per_text)[self.text]
        place = (np.arange(len(of)) - np.repeat(first, self.n)).astype(np.uint64) << np.uint64(1)
        self.template, self.said = self.hashed(self.tokens, place), self.hashed(raw, place)

    def hashed(self, tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(tokens):
            return np.zeros(0, np.int64)
        return mixed(np.add.reduceat(mixed(tokens ^ mixed(place, 3), 4), self.begin) + self.n.astype(np.uint64), 5) \
            .view(np.int64)

    def leaves(self, rows: np.ndarray) -> list[np.ndarray]:
        """The leaf of lines in the tree over their first tokens, and in the tree over their last."""
        begin, n, out = self.begin[rows], self.n[rows], []
        for first, step in ((begin, 1), (begin + n - 1, -1)):
            leaf = mixed(n.astype(np.uint64), 7 + step)
            for i in range(DEPTH if len(rows) else 0):
                leaf = mixed(leaf ^ self.tokens[np.clip(first + step * i, 0, len(self.tokens) - 1)], 9)
            out.append(leaf.view(np.int64))
        return out

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A line for each template, and the smallest and largest id of the texts that have it."""
        order = np.lexsort((ids[self.text], self.template))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(self.template[order]) != 0
        lasts = order[np.append(np.flatnonzero(new)[1:], len(order)) - 1] if len(order) else order
        at = order[new]
        return at, ids[self.text[at]], ids[self.text[lasts]]

    def again(self) -> np.ndarray:
        """Whether the text says the same tokens on an earlier line."""
        order = np.lexsort((self.number, self.said, self.text))
        same = np.zeros(len(order), bool)
        same[order[1:]] = (self.said[order[1:]] == self.said[order[:-1]]) & (self.text[order[1:]] == self.text[order[:-1]])
        return same


def parsed(docs: DataFrame, schema: str, finish) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for part in slices(batch, CHARS):
                columns = finish(Parsed(texts_of(part)), part.column("id").to_numpy(), part.column("text_hash").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return keyed(docs).select("id", "text_hash", "text").mapInArrow(run, schema)


def keys(docs: DataFrame) -> DataFrame:
    """The templates and the leaves of each range of documents, a template once: smallest and largest id."""

    def finish(lines: Parsed, ids, hashes) -> list:
        at, owner, last = lines.distinct(ids)
        long = lines.n[at] >= LEAST_TOKENS
        leaves = lines.leaves(at[long])
        return [np.concatenate((lines.template[at], *leaves)), np.arange(len(at) + 2 * long.sum()) >= len(at),
                np.concatenate((owner, owner[long], owner[long])), np.concatenate((last, last[long], last[long]))]

    return parsed(docs, KEYS, finish)


def templates(docs: DataFrame) -> DataFrame:
    """The templates that may vary of each range of documents, once each: leaves, token codes, smallest id."""

    def finish(lines: Parsed, ids, hashes) -> list:
        at, owner, _ = lines.distinct(ids)
        long = lines.n[at] >= LEAST_TOKENS
        at, owner = at[long], owner[long]
        codes = (lines.tokens >> np.uint64(48)).astype("<u2")[ragged(lines.begin[at], lines.n[at])]
        ends = np.concatenate(([0], np.cumsum(lines.n[at]))).astype(np.int32) * 2
        packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
        return [lines.template[at], *lines.leaves(at), packed, owner]

    return parsed(docs, TEMPLATES, finish)


def line_rows(docs: DataFrame) -> DataFrame:
    """A row per line that holds a token: the document, the line's number, its template, whether it repeats one before."""
    return parsed(docs, LINES, lambda lines, ids, hashes: [
        ids[lines.text], hashes[lines.text], lines.number.astype(np.int32), lines.template, lines.again()])


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with the key of a row: its id (a stand-in for null) and a hash of its text."""
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text": F.col("text").cast("string"),
                             "text_hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def least_owners(codes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each template of a leaf (a row of token codes) the smallest owner among those alike with it, itself included."""
    least, need = owners.copy(), -(-SHARE * codes.shape[1] // 100)
    step = max(1, (1 << 24) // codes.size)
    for a in range(0, len(codes), step):
        near = (codes[a:a + step, None] == codes[None]).sum(axis=2) >= need
        least[a:a + step] = np.where(near, owners, NO_ID).min(axis=1)
    return np.minimum(least, owners)


def alike_owners(found: DataFrame, large: DataFrame) -> DataFrame:
    """h, owner: for templates alike with another of their leaf the smallest id of a document that has that one.

    A leaf of many templates (`large`: leaf, c parts) is dealt to cells of two parts each.
    """
    key = ["leaf", "a", "b"]
    own = F.pmod(F.xxhash64("h"), F.col("c"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1),
                        lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    dealt = found.withColumn("leaf", F.explode(F.array("head", "tail"))).join(large, "leaf", "left") \
        .withColumn("c", F.coalesce("c", F.lit(1).cast("long"))).withColumn("cell", F.explode(cells)) \
        .select("leaf", "cell.a", "cell.b", "h", "codes", "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            owners, h = rows.column("owner").to_numpy(), rows.column("h").to_numpy()
            least, codes = owners.copy(), rows.column("codes")
            for a, b in zip(edges, edges[1:]):
                if b - a > 1 and (h[a:b] != h[a]).any():
                    of_leaf = codes.slice(a, b - a).to_pylist()
                    alike = [c for c in of_leaf if len(c) == len(of_leaf[0])]  # but for a clash of hashes, all
                    if len(alike) == b - a:
                        least[a:b] = least_owners(np.frombuffer(b"".join(alike), "<u2").reshape(b - a, -1), owners[a:b])
            found = np.flatnonzero(least < owners)
            return pa.RecordBatch.from_arrays([pa.array(h[found]), pa.array(least[found])], ["h", "owner"])

        def cut(whole: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            groups = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in key])
            edges = np.concatenate(([0], np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0)) + 1))
            if whole:
                edges = np.append(edges, rows.num_rows)
            if len(edges) > 1:
                yield compared(rows.slice(0, int(edges[-1])), edges)
            held[:] = rows.slice(int(edges[-1])).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            yield from cut(False)
        if held:
            yield from cut(True)

    n = shuffle_partitions(found.sparkSession)
    return dealt.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "h long, owner long")


def recurring(docs: DataFrame) -> DataFrame:
    """h, owner: templates that recur over documents, as they are or alike, and the smallest id that has one."""
    seen = write_through(keys(docs).groupBy("key", "leaf").agg(
        F.count("*").alias("n"), F.min("owner").alias("owner"), F.max("last").alias("last"))
        .where((F.col("owner") < F.col("last")) & (~F.col("leaf") | (F.col("n") > PART))), "templates")
    large = write_through(seen.where("leaf").select(F.col("key").alias("leaf"), F.ceil(F.col("n") / PART).alias("c")), "leaves")
    equal = seen.where("not leaf").select(F.col("key").alias("h"), "owner")
    return equal.unionByName(alike_owners(templates(docs), large)).groupBy("h").agg(F.min("owner").alias("owner"))


def masks(drops: DataFrame) -> DataFrame:
    """id, text_hash, _went (lines dropped), _drop: an array that tells for each line, up to the last dropped, if it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            went, out = [], []
            for lines in batch.column("lines").to_pylist():
                mask = np.zeros(max(lines) + 1, bool)
                mask[lines] = True
                went.append(int(mask.sum()))
                out.append(mask)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(went, pa.int32()),
                                              pa.array(out, pa.list_(pa.bool_()))], ["id", "text_hash", "_went", "_drop"])

    return drops.groupBy("id", "text_hash").agg(F.collect_list("line").alias("lines")) \
        .mapInArrow(run, "id long, text_hash long, _went int, _drop array<boolean>")


def drop_recurring_lines(docs: DataFrame, count: str | None = "dropped_lines") -> DataFrame:
    """`docs` without the lines whose template recurs across documents, n_chars brought in line.

    A column `count` says how many lines went, in place of any of that name; None leaves it out.

    A template is a line's tokens with those that hold digits as fields, unless they are more than half of them. A leaf
    of the tree holds the templates of one number of tokens and the same DEPTH tokens in front (of a second tree: at the
    end). Templates of a leaf with LEAST_TOKENS tokens or more are alike if SHARE per cent of their tokens agree, place
    by place. A line goes if a document of a smaller doc_id has its template or one alike, so each document keeps all that
    no document before it says. Where a template recurs, its first document keeps lines with the same tokens once.
    Rows that share a doc_id count as one document, and so do rows without doc_id, which come last. Blank lines and null
    texts always stay; other columns are passed through. Texts and lines of any length are parsed whole.

    The texts are parsed three times by array operations; only hashes and token codes of templates are compared. Copies of a
    line are merged per range of documents before they are shuffled. Leaves beyond PART templates are dealt to cells.
    """
    hit = line_rows(docs).join(recurring(docs), "h") \
        .where((F.col("owner") < F.col("id")) | (F.col("owner") == F.col("id")) & F.col("again"))
    kept = F.array_join(F.filter(F.split(F.col("text"), "\n", -1),
                                 lambda _, i: ~F.coalesce(F.get("_drop", i), F.lit(False))), "\n")
    out = keyed(docs.withColumnsRenamed({c: f"_in_{i}" for i, c in enumerate(docs.columns)})
                .withColumns({"doc_id": F.col(f"_in_{docs.columns.index('doc_id')}"),
                              "text": F.col(f"_in_{docs.columns.index('text')}")})) \
        .join(masks(hit), ["id", "text_hash"], "left") \
        .withColumn("text", F.when(F.col("_went") > 0, kept).otherwise(F.col("text")))
    new = {c: F.col(f"_in_{i}") for i, c in enumerate(docs.columns)} | {"text": F.col("text")}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("_went") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(new["n_chars"])
    went = [F.coalesce("_went", F.lit(0)).alias(count)] if count else []
    return out.select(*[new[c].alias(c) for c in docs.columns if c != count], *went)
