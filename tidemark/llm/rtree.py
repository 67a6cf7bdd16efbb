"""Hard negatives by R-trees packed with sort-tile-recursive: boxes bound inner products, a best-first queue prunes them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions
from tidemark.session import write_through

#: Rows of a tree, rows of a leaf, boxes of a node.
TILE, LEAF, FAN = 1 << 13, 128, 8
#: Dimensions that the rows of a tree are tiled by, those of widest spread.
TILED = 3
#: Anchors whose bounds are worked out at once.
ANCHORS = 64
#: Sums of whole numbers are exact in doubles up to here.
EXACT = 1 << 53
LONG = (1 << 63) - 1
TILE_SCHEMA = "dims int, tile long, ids binary, labels binary, asks binary, kind string, vectors binary"


def tiled_order(vectors: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive: slabs along the widest dimension, in each slabs along the next, the last sorted."""
    spread = vectors.max(axis=0) - vectors.min(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
    axes = np.argsort(-spread, kind="stable")[:TILED]

    def tiled(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
        if not len(axes) or len(rows) <= LEAF:
            return rows
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        slabs = math.ceil((len(rows) / LEAF) ** (1 / len(axes)))
        width = LEAF * math.ceil(len(rows) / LEAF / slabs)
        return np.concatenate([tiled(rows[i:i + width], axes[1:]) for i in range(0, len(rows), width)])

    return tiled(np.arange(len(vectors)), axes)


def tiles_of(rows: DataFrame) -> DataFrame:
    """One row per tree: its rows in the order of its leaves. `rows` has dims, label, id, asks and v, sorted by range."""

    def packed(dims: int, tile: int, ids, labels, asks, vectors) -> pa.RecordBatch:
        order = tiled_order(vectors)
        kind = "<i4" if np.abs(vectors).max(initial=0) < 1 << 31 else "<f8"
        values = [dims, tile, ids[order].tobytes(), labels[order].tobytes(), asks[order].tobytes(), kind,
                  vectors[order].astype(kind).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [
            pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()])],
            ["dims", "tile", "ids", "labels", "asks", "kind", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, dims, held, size = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            of_rows = batch.column("dims").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of_rows)) + 1), len(of_rows)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if held and (of_rows[a] != dims or size == TILE):
                        yield packed(dims, tile, *map(np.concatenate, zip(*held)))
                        tile, held, size = tile + 1, [], 0
                    dims = int(of_rows[a])
                    n = min(b - a, TILE - size)
                    part = batch.slice(a, n)
                    held.append((part.column("id").to_numpy(), part.column("label").to_numpy(),
                                 part.column("asks").to_numpy(zero_copy_only=False),
                                 part.column("v").flatten().to_numpy().reshape(n, dims)))
                    a, size = a + n, size + n
        if held:
            yield packed(dims, tile, *map(np.concatenate, zip(*held)))

    by = ["dims", "label", "first", "_tie"]
    keyed = rows.withColumns({"first": F.try_element_at("v", F.lit(1)), "_tie": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by) \
        .select("dims", "label", "id", "asks", "v").mapInArrow(run, TILE_SCHEMA)


def vectors_of(tile: dict) -> np.ndarray:
    return np.frombuffer(tile["vectors"], tile["kind"]).reshape(len(tile["ids"]) // 8, tile["dims"])


class Forest:
    """The trees of a cell: all rows, and the boxes over them from the leaves up to one root per tree."""

    def __init__(self, tiles: list[dict]):
        self.ids = np.concatenate([np.frombuffer(t["ids"], np.int64) for t in tiles])
        self.labels = np.concatenate([np.frombuffer(t["labels"], np.int64) for t in tiles])
        self.vectors = np.concatenate([vectors_of(t) for t in tiles]).astype(np.float64)
        self.most = float(np.abs(self.vectors).max(initial=0))
        boxes, self.roots, self.below, row = [], [], [], 0
        for t in tiles:
            n = len(t["ids"]) // 8
            at = np.arange(0, n, LEAF)
            mine, named = self.vectors[row:row + n], self.labels[row:row + n]
            level = [np.minimum.reduceat(mine, at), np.maximum.reduceat(mine, at),
                     np.minimum.reduceat(named, at), np.maximum.reduceat(named, at)]
            self.below += [(True, row + a, row + min(a + LEAF, n)) for a in at.tolist()]
            while True:
                boxes.append(level)
                width = len(level[0])
                if width == 1:
                    break
                at = np.arange(0, width, FAN)
                first = len(self.below) - width
                self.below += [(False, first + a, first + min(a + FAN, width)) for a in at.tolist()]
                level = [f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), level)]
            self.roots.append(len(self.below) - 1)
            row += n
        self.low, self.high, self.label_low, self.label_high = (np.concatenate(x) for x in zip(*boxes))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, box]: the inner products of a query with a box's points lie between these, coordinate by coordinate."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        if not self.exact(queries):
            wide = np.full((len(queries), len(self.low)), np.inf)
            return -wide, wide
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T

    def exact(self, queries: np.ndarray) -> bool:
        return queries.shape[1] * self.most * float(np.abs(queries).max(initial=0)) < EXACT

    def scores(self, a: int, b: int, query: np.ndarray) -> np.ndarray:
        if self.exact(query[None]):
            return self.vectors[a:b] @ query
        whole = [int(x) for x in query]
        return np.array([max(-LONG - 1, min(LONG, sum(int(x) * y for x, y in zip(v, whole)))) for v in self.vectors[a:b]],
                        object)

    def search(self, query, own: int, label: int, alike: bool, windows: list[tuple], k: int, low, high) -> list[list]:
        """For each window (least, most score) the k best rows of the label, or of others: (-score, id), best first.

        The queue opens the box of highest bound first. A box is passed over if its labels can't fit, or if for every
        window it lies outside or strictly below the k-th score found; the search ends when no bound reaches any window.
        """
        found: list[list] = [[] for _ in windows]
        floors = [least for least, _ in windows]
        if alike:
            fits = (self.label_low <= label) & (label <= self.label_high)
        else:
            fits = (self.label_low != label) | (self.label_high != label)
        queue = [(-high[r], r) for r in self.roots if fits[r]]
        heapq.heapify(queue)
        while queue:
            top, box = heapq.heappop(queue)
            if -top < min(floors):
                break
            open_ = [w for w, (_, most) in enumerate(windows) if -top >= floors[w] and low[box] <= most]
            if not open_:
                continue
            leaf, a, b = self.below[box]
            if not leaf:
                for child in range(a, b):
                    if fits[child]:
                        heapq.heappush(queue, (-high[child], child))
                continue
            scores = self.scores(a, b, query)
            other = (self.ids[a:b] != own) & ((self.labels[a:b] == label) == alike)
            for w in open_:
                rows = np.flatnonzero(other & (scores >= floors[w]) & (scores <= windows[w][1]))
                if len(rows):
                    found[w] = sorted(found[w] + [(-int(scores[r]), int(self.ids[a + r])) for r in rows])[:k]
                    if len(found[w]) == k:
                        floors[w] = max(floors[w], -found[w][-1][0])
        return found


def searched(tiles: DataFrame, anchors: DataFrame, alike: bool, k: int, share: tuple[int, int], query_cells: int) -> DataFrame:
    """key, anchor_id, asked, id, score: the best k rows of each cell for each anchor and asked score.

    `anchors` has key, dims, id, label, v, and asked, the scores whose windows are searched (alike: one window, all).
    """
    cells = shuffle_partitions(tiles.sparkSession)
    left = tiles.withColumns({"c": F.pmod(F.xxhash64("tile"), F.lit(cells)).cast("int"),
                              "q": F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1)))})
    right = anchors.withColumns({"c": F.explode(F.sequence(F.lit(0), F.lit(cells - 1))),
                                 "q": F.pmod(F.xxhash64("key"), F.lit(query_cells)).cast("int")})

    def window(score) -> tuple:
        if alike:
            return -math.inf, math.inf
        return -(-share[0] * score // 100), share[1] * score // 100

    def run(tiles: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        asks = anchors.sort_by("key").to_pylist() if tiles.num_rows else []
        forests: dict[int, Forest] = {}
        for dims in {a["dims"] for a in asks}:
            of_dims = [t for t in tiles.to_pylist() if t["dims"] == dims]
            if of_dims:
                forests[dims] = Forest(of_dims)
        for dims, forest in forests.items():
            ours = [a for a in asks if a["dims"] == dims]
            for at in range(0, len(ours), ANCHORS):
                part = ours[at:at + ANCHORS]
                queries = np.array([a["v"] for a in part], np.float64).reshape(len(part), dims)
                low, high = forest.bounds(queries)
                for i, a in enumerate(part):
                    found = forest.search(queries[i], a["id"], a["label"], alike, [window(s) for s in a["asked"]], k,
                                          low[i], high[i])
                    out += [(a["key"], a["id"], s, row, -score) for s, rows in zip(a["asked"], found) for score, row in rows]
        columns = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("key", "anchor_id", "asked", "id", "score"), columns)})

    return left.groupBy("c", "q").cogroup(right.groupBy("c", "q")) \
        .applyInArrow(run, "key long, anchor_id long, asked long, id long, score long")


def anchors_of(tiles: DataFrame) -> DataFrame:
    """key, dims, id, label, v of the rows that ask; the key tells rows that share an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(t["asks"], bool))
                vectors = vectors_of(t)[at].astype(np.float64)
                columns = [pa.array((t["tile"] << 16) + at), pa.array([t["dims"]] * len(at), pa.int32()),
                           pa.array(np.frombuffer(t["ids"], np.int64)[at]), pa.array(np.frombuffer(t["labels"], np.int64)[at]),
                           pa.array(list(vectors), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "dims", "id", "label", "v"])

    return tiles.mapInArrow(run, "key long, dims int, id long, label long, v array<double>")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: float = 256.0,
                   query_cells: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x), scores are whole inner products, ties go to the smaller id. The positives of an
    anchor are the best rows of its label, the negatives of both the best rows of another label whose score lies within
    `share` per cent of the positive's. Rows without id, label or vector, or with a null, NaN or infinite component, take
    no part. Every other row counts, rows that share an id too: each is an anchor, positive or negative of its own, but
    never one for a row of the same id. An anchor is compared with vectors of its own length. Beyond 2^53 sums are
    worked out in whole numbers, and stop at the ends of a long. No rows, no result.

    Rows are sorted by label and first component into ranges, a tree is packed over every TILE of them. Trees and anchors
    are dealt to a grid of cells; a cell hands on k rows for each question, so the work is anchors x rows less what the
    boxes spare, and no task holds more than its cell.
    """
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(
        F.size(vector_col).alias("dims"), label.cast("long").alias("label"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"), whole.alias("v")).where("label is not null")
    tiles = write_through(tiles_of(rows), "tiles")
    query_cells = query_cells or -(-shuffle_partitions(vectors.sparkSession) // 64)
    anchors = anchors_of(tiles)
    near = searched(tiles, anchors.withColumn("asked", F.array(F.lit(0).cast("long"))), True, positives, share, query_cells)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    best = write_through(near.withColumn("place", place).where(F.col("place") <= positives)
                         .select("key", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("asked")), "positives")
    asked = best.groupBy("key").agg(F.array_sort(F.collect_set("asked")).alias("asked"))
    far = searched(tiles, anchors.join(asked, "key"), False, negatives, share, query_cells)
    rank = F.row_number().over(Window.partitionBy("key", "asked").orderBy(F.desc("score"), "id"))
    found = far.withColumn("rank", rank).where(F.col("rank") <= negatives).drop("anchor_id")
    return best.join(found, ["key", "asked"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("asked").alias("positive_score"),
        F.col("score").alias("negative_score"))
