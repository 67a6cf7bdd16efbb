"""Near-duplicates by shared word shingles: wide SimHashes find candidates by bit planes, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import neardup
from tidemark.llm.common import free_name, ragged, shuffle_partitions, slices, texts_of
from tidemark.llm.components import components
from tidemark.session import write_through

#: A fingerprint is four longs.
WIDE = ["f0", "f1", "f2", "f3"]
#: Its 32 bytes form groups of so many neighbours; each two bytes of a group key a table.
GROUP = 4
#: Texts that share four fifths of their shingles differ in 39 of 256 bits on average, give or take 6.
RADIUS = 52
#: Rows of a bucket that are compared at once, and shingles of a candidate group that are checked at once.
PART = 4096
SHINGLES = 1 << 20
#: Small groups are laid side by side until a block has so many rows.
BLOCK = 256
#: Characters of a slice of documents whose shingles a worker holds at once.
CHARS = 1 << 19
#: Odd numbers that make further hashes of one hash.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles, A-Z lower-cased; fewer words are one shingle, none give none."""
    joined, begins, ends = neardup.shingles(text, words)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(begins.tolist(), ends.tolist())]
    return np.unique(np.array(hashes, np.uint64))


def wide_simhash(shingles: np.ndarray) -> np.ndarray:
    """Four words whose bits are set if set in over half of the shingles' hashes, each mixed in four ways."""
    votes = np.zeros(64 * len(MIXERS), np.int64)
    for at in range(0, len(shingles), 16384):
        h = shingles[at:at + 16384, None] * MIXERS
        h = (h ^ h >> np.uint64(29)) * MIXERS[::-1]
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(votes * 2 > len(shingles), bitorder="little").view("<u8")


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by `key` in tables of whole groups, as many small groups to a table as reach `rows`."""
    kept, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
        new = np.concatenate(([last is not None and (groups[:, 0] != last).any()],
                              (groups[:, 1:] != groups[:, :-1]).any(axis=0)))
        last, begin = groups[:, -1], 0
        for edge in np.flatnonzero(new).tolist():
            if size + edge - begin >= rows:
                yield pa.Table.from_batches([*kept, batch.slice(begin, edge - begin)])
                kept, size, begin = [], 0, edge
        kept.append(batch.slice(begin))
        size += batch.num_rows - begin
    if size:
        yield pa.Table.from_batches(kept)


def wide_of(block: pa.Table) -> np.ndarray:
    return np.stack([block.column(f).to_numpy() for f in WIDE], axis=1).astype(np.int64).view(np.uint64)


def candidates(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links between rows of `classes` (node, f0 to f3) that join those within the radius which share a bucket.

    Of each group of neighbouring bytes any two key a table. Of texts that share just four fifths of their shingles
    94 % share a bucket, of those that share nine tenths 99.8 %. Within a bucket a row is linked with the first of its
    group only. Buckets beyond PART rows are dealt to cells, a cell for each two parts.
    """
    at = [F.shiftrightunsigned(f, 8 * i).bitwiseAND(F.lit(255)).cast("int") for f in WIDE for i in range(8)]
    pairs = [p for g in range(0, len(at), GROUP) for p in combinations(range(g, g + GROUP), 2)]
    keys = [F.lit(t << 16).bitwiseOR(F.shiftleft(at[a], 8)).bitwiseOR(at[b]) for t, (a, b) in enumerate(pairs)]
    rows = classes.select("node", *WIDE, F.explode(F.array(*keys)).alias("k"))
    hot = rows.groupBy("k").count().where(F.col("count") > PART).select("k", F.ceil(F.col("count") / PART).alias("c"))
    hot = F.broadcast(hot)  # at most one row per key, and there are 48 * 65,536 keys
    cells = in_cells(rows.join(hot, "k", "left").withColumn("c", F.coalesce("c", F.lit(1).cast("long"))), ["k"])
    key = ["k", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, key, BLOCK):
            groups = np.stack([block.column(c).to_numpy() for c in key])
            same = (groups[:, 1:] == groups[:, :-1]).all(axis=0)
            shared = np.append(same, False) | np.insert(same, 0, False)
            if shared.any():
                node = block.column("node").to_numpy()[shared]
                first = node[neardup.linked(wide_of(block)[shared], radius)]
                moved = first != node
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(first[moved])], ["u", "v"])

    n = shuffle_partitions(classes.sparkSession)
    return cells.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long").distinct()


def in_cells(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with cells a <= b of their group (`key`): of its c parts, each two meet in one cell."""
    own = F.pmod(F.xxhash64("node"), F.col("c"))
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1),
                       lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    return rows.withColumn("cell", F.explode(cell)).withColumns({"a": F.col("cell.a"), "b": F.col("cell.b")}).drop("cell", "c")


def alike(fps: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows with a Jaccard similarity that is high enough, as many as join all such within the radius.

    Bit planes give a row's candidates; those that it isn't joined with yet are compared shingle by shingle, at once.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(sets)
    label, planes, found = np.arange(len(fps)), neardup.bit_planes(fps), []
    for begin in range(0, len(fps), neardup.ROWS):
        near = neardup.near(fps, planes, begin, min(begin + neardup.ROWS, len(fps)), radius)
        for r in np.flatnonzero(near.any(axis=1)) if near is not None else ():
            row = begin + int(r)
            others = np.flatnonzero(np.unpackbits(near[r].view(np.uint8), bitorder="little"))
            small, large = np.minimum(sizes[others], sizes[row]), np.maximum(sizes[others], sizes[row])
            others = others[(label[others] != label[row]) & (small >= similarity * large - 1e-9) & (small > 0)]
            if not len(others):
                continue
            values = flat[ragged(starts[others], sizes[others])]
            own = sets[row]
            hits = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            common = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
            others = others[common >= similarity * (sizes[others] + sizes[row] - common) - 1e-9]
            if len(others):
                roots, first = np.unique(label[others], return_index=True)
                found += [(row, int(o)) for o in others[first]]
                label[np.isin(label, np.append(roots, label[row]))] = min(int(roots[0]), int(label[row]))
    return found


def one_of_each(docs: DataFrame, similarity: float = 0.8, words: int = 5, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """Exactly one row of `docs` for each group of near-duplicates: that of the smallest doc_id, rows without an id last.

    Rows link if the sets of their word shingles (A-Z lower-cased, white space of ASCII between words) have a Jaccard
    similarity of `similarity` or more; a group is what links reach. Rows with equal sets are one class, so exact copies
    cost one comparison; texts without words, null ones among them, have the empty set and are one class too. Candidates
    come from 256-bit SimHashes, and each link is checked on the whole sets, so nothing else is dropped; a link may be
    missed if the hashes differ in more than `radius` bits or share no bucket (see `candidates`). A candidate group
    of more than SHINGLES shingles is checked in cells of two parts each, so no task holds a whole group.

    A row is known by its id, its text and its other columns (maps aside), so rows that share an id are told apart;
    of rows equal in all of these any may stay. Very long texts count whole; their sets take 8 bytes per word.
    """
    key = free_name("_row", docs)
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(key, F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("text"), F.xxhash64(*hashed).alias("whole")))
    texts = keyed.select(F.col(key).alias("key"), text.alias("text"))
    key_type = "struct<none:boolean,id:long,text:long,whole:long>"

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, CHARS) for b in batches):
            sets = [shingle_set(t, words, seed) for t in texts_of(batch)]
            wide = np.array([wide_simhash(s) for s in sets], np.uint64).reshape(-1, len(WIDE)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), *[pa.array(w) for w in np.ascontiguousarray(wide.T)]],
                ["key", "digest", "n", *WIDE])

    rows = texts.mapInArrow(hash_rows, f"key {key_type}, digest binary, n long, " + ", ".join(f"{f} long" for f in WIDE))
    classes = write_through(rows.groupBy("digest").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ["n", *WIDE]])
                            .drop("digest").withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.join(components(candidates(classes, radius)), "node")
    large = members.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") > SHINGLES) \
        .select("label", F.ceil(F.col("n") / SHINGLES).alias("c"))
    members = write_through(members.join(large, "label", "left").withColumn(  # written: Spark then knows its size
        "c", F.coalesce("c", F.lit(1).cast("long"))), "members")
    chosen = texts.join(members, "key").dropDuplicates(["key"]).select("node", "label", "c", *WIDE, "text")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, CHARS) for b in batches):
            sets = pa.array([shingle_set(t, words, seed).tobytes() for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], [*batch.schema.names[:-1], "shingles"])

    schema = "node long, label long, c long, " + ", ".join(f"{f} long" for f in WIDE) + ", shingles binary"
    cells = in_cells(chosen.mapInArrow(with_sets, schema), ["label"])
    place = ["label", "a", "b"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, place, BLOCK):
            node = block.column("node").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in block.column("shingles").to_pylist()]
            found = alike(wide_of(block), sets, similarity, radius)
            u, v = node[[i for i, _ in found]] if found else [], node[[j for _, j in found]] if found else []
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = shuffle_partitions(docs.sparkSession)
    links = cells.repartition(n, *place).sortWithinPartitions(*place).mapInArrow(check, "u long, v long")
    kept = classes.join(components(links), "node", "left").groupBy(F.coalesce("label", "node")) \
        .agg(F.min("key").alias(key)).select(key)
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
