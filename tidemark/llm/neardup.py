"""Near-duplicates by SimHash: fingerprints stored as bit planes, many distances updated by bitwise counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, texts_of
from tidemark.llm.components import components
from tidemark.session import write_through

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a bucket that are compared at once; a larger bucket is dealt to cells of two such parts each.
PART = 4096
#: Small buckets are laid side by side until a block has so many rows.
BLOCK = 512
#: Rows whose distances to a block are counted at once.
ROWS = 256


def shingles(text: str, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, and where each shingle begins and ends; fewer words are one shingle, none give none."""
    parts = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, white space of ASCII only
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = begins + sizes
    if len(parts) < words:
        begins, ends = begins[:1], ends[-1:]
    else:
        begins, ends = begins[:len(parts) - words + 1], ends[words - 1:]
    return b" ".join(parts), begins, ends


def simhash(text: str, words: int = 4, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the XXH64 hashes of the word shingles; 0 without words."""
    joined, begins, ends = shingles(text, words)
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(begins), 65536):
        hashes = [digest(joined[a:b], seed) for a, b in zip(begins[at:at + 65536].tolist(), ends[at:at + 65536].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, words, seed) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """A row for each bit of the fingerprints (of one word, or a row of words each), holding that bit of all of them.

    64 to a word; the last word is filled up with zeros.
    """
    width = 8 * fps[:1].size or 8
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, width), axis=1, bitorder="little")
    packed = np.packbits(np.pad(bits, ((0, -len(fps) % 64), (0, 0))), axis=0, bitorder="little")
    return np.ascontiguousarray(packed.T).view("<u8")


def near(fps: np.ndarray, planes: np.ndarray, begin: int, end: int, radius: int) -> np.ndarray | None:
    """For rows begin..end a bit for each fingerprint of the block that is within the radius; None if none is.

    Differences of two planes enter the lowest counter through a full adder, carries ripple upwards; what overflows or
    exceeds the radius stays marked, and the block is left as soon as all is marked.
    """
    depth = (radius + 1).bit_length()
    over = np.zeros((end - begin, planes.shape[1]), np.uint64)
    for r, row in enumerate(range(begin, end)):  # a row is compared with later ones only
        over[r, :(row + 1) // 64] = ALL
        if (row + 1) % 64:
            over[r, (row + 1) // 64] |= np.uint64((1 << (row + 1) % 64) - 1)
    if len(fps) % 64:
        over[:, -1] |= ALL << np.uint64(len(fps) % 64)
    counts = [np.zeros_like(over) for _ in range(depth)]
    words = fps[begin:end].reshape(end - begin, -1)
    for b in range(0, len(planes), 2):
        own = words[:, b // 64, None] >> np.uint64(b % 64)
        one = planes[b] ^ (np.uint64(0) - (own & np.uint64(1)))
        two = planes[b + 1] ^ (np.uint64(0) - (own >> np.uint64(1) & np.uint64(1)))
        either = counts[0] ^ one
        carry = counts[0] & one | two & either
        counts[0] = either ^ two
        for d in range(1, depth):
            carry, counts[d] = counts[d] & carry, counts[d] ^ carry
        over |= carry
        if b % 8 == 6 and b >= radius:
            over |= beyond(counts, radius)
            if (over == ALL).all():
                return None
    return ~over


def beyond(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Marks where the counter exceeds the radius."""
    more, same = np.zeros_like(counts[0]), np.full_like(counts[0], ALL)
    for d in reversed(range(len(counts))):
        if radius >> d & 1:
            same &= counts[d]
        else:
            more |= same & counts[d]
            same &= ~counts[d]
    return more


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of the first one that it is linked with, in any number of steps."""
    label = np.arange(len(fps))
    planes = bit_planes(fps)
    links = []
    for begin in range(0, len(fps), ROWS):
        end = min(begin + ROWS, len(fps))
        alive = near(fps, planes, begin, end, radius)
        if alive is not None:
            links += [(begin + r, alive[r]) for r in np.flatnonzero(alive.any(axis=1))]
    changed = bool(links)
    while changed:
        changed = False
        for row, bits in links:
            members = np.append(np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")), row)
            least = label[members].min()
            if (label[members] != least).any():
                label[members] = least
                changed = True
    return label


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """u, v: links between different fingerprints (column fp, distinct) that join all those within the radius.

    Of `blocks` parts of the bits, two fingerprints within the radius share at least blocks - radius; each choice of so
    many parts is a table, and its buckets are compared. Within a bucket a row is linked with the first of its group
    only, so a bucket of n rows hands on fewer than n links. Buckets beyond PART rows are dealt to cells.
    """
    blocks = blocks or radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(
        F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, m in enumerate(masks)]))
    rows = fps.select("fp", tables.alias("x")).select("fp", "x.t", "x.k")
    full = rows.groupBy("t", "k").count().where("count > 1").select("t", "k", F.ceil(F.col("count") / PART).alias("c"))
    own = F.pmod(F.xxhash64("fp"), F.col("c"))
    cell = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1),
                       lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    cells = rows.join(full, ["t", "k"]).withColumn("cell", F.explode(cell)).select("t", "k", "cell.a", "cell.b", "fp")
    key = ["t", "k", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last = [], None

        def flush(at: int) -> pa.RecordBatch:
            block = np.concatenate(kept)
            kept[:] = [block[at:]]
            fps = block[:at]
            label = linked(fps, radius)
            moved = label != np.arange(len(fps))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)),
                                               pa.array(fps[label[moved]].view(np.int64))], ["u", "v"])

        size = 0
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            groups = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
            new = np.concatenate(([last is not None and (groups[:, 0] != last).any()],
                                  (groups[:, 1:] != groups[:, :-1]).any(axis=0))) if len(fps) else np.zeros(0, bool)
            base = size
            kept.append(fps)
            size += len(fps)
            last = groups[:, -1] if len(fps) else last
            done = 0
            for edge in base + np.flatnonzero(new):
                if edge - done >= BLOCK:
                    yield flush(int(edge - done))
                    done = int(edge)
            size -= done
        if size:
            yield flush(size)

    n = shuffle_partitions(fps.sparkSession)
    return cells.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42,
                    blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of `docs`.

    Rows link if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id that can be
    reached, the row's own included. Null and empty texts have the fingerprint zero and link like any other. A row
    without doc_id gets a component but never names one, unless it reaches no id: then it is null. Repeated rows stay.
    Equal fingerprints are one node of the graph; only links between different ones are searched for.
    """
    fps = write_through(fingerprints(docs, words, seed), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(classes.select("fp"), radius, blocks))
    labelled = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("label", F.coalesce("label", "fp"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(ids, "label").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
