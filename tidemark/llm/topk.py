"""Exact top-k by inner product: vertical layout, dimension blocks, candidates compacted by what is left to gain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions

#: Dimensions accumulated before candidates are compacted.
WIDTH = 16
#: Beyond this magnitude sums may leave the exact range of doubles, and whole numbers of any size are used.
EXACT = 1 << 20
LONG = (1 << 63) - 1


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(ids, vectors, query_ids, queries, k: int, width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best of each query; all arguments hold whole numbers, vectors as rows."""
    if max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0)) > EXACT:
        return plain(ids, vectors, query_ids, queries, k)
    dims = vectors.shape[1]
    if dims == 0:
        return plain(ids, vectors, query_ids, queries, k)
    columns = np.ascontiguousarray(vectors.T)  # one row per dimension
    cuts = list(range(0, dims, width)) + [dims]
    mass = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts[1:]]
    left = [np.sqrt((queries[:, c:] ** 2).sum(axis=1)) for c in cuts[1:]]
    out = []
    for q, query_id in enumerate(query_ids):
        alive = np.flatnonzero(ids != query_id)
        total = np.zeros(len(alive))
        for b, (c, d) in enumerate(zip(cuts, cuts[1:])):
            block = columns[c:d] if len(alive) == len(ids) else columns[c:d, alive]
            total = total + queries[q, c:d] @ block
            if d < dims and len(alive) > k:
                rest = mass[b][alive] * left[b][q] + 1.0  # one covers the rounding of the roots
                floor = np.partition(total - rest, len(alive) - k)[len(alive) - k]
                keep = total + rest >= floor
                alive, total = alive[keep], total[keep]
        top = best(ids[alive], total, k)
        out += [(int(query_id), int(ids[alive[t]]), int(total[t])) for t in top]
    return out


def plain(ids, vectors, query_ids, queries, k: int) -> list[tuple[int, int, int]]:
    """The same by whole numbers without bounds; scores beyond a long stop at its ends."""
    exact = np.array([[int(x) for x in v] for v in vectors], object).reshape(vectors.shape)
    out = []
    for query_id, query in zip(query_ids, queries):
        scores = [(-sum(int(a) * b for a, b in zip(query, v)), int(i)) for i, v in zip(ids, exact) if i != query_id]
        out += [(int(query_id), i, max(-LONG - 1, min(LONG, -s))) for s, i in sorted(scores)[:k]]
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, query_cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `is_query` holds, the k rows of highest inner product.

    Components are floor(scale * x), scores whole numbers, ties go to the smaller id. Vectors that are null or hold a
    null, NaN or infinity take no part, nor do rows without id; a query is compared with vectors of its own length,
    never with rows of its own id. Every other row counts, rows that share an id too; queries that share one are answered
    together, by the k best of all their scores. No rows, no result.

    Both sides are dealt to a grid of cells (candidate cells x query cells, their numbers from the shuffle
    partitions), so that a cell holds a bounded share of each; cells hand on k rows per query.
    """
    spark = vectors.sparkSession
    cells = shuffle_partitions(spark)
    query_cells = query_cells or -(-cells // 64)
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(
        F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    spread = F.xxhash64(F.col(id_col).cast("long"))
    left = rows.select(F.pmod(spread, F.lit(cells)).cast("int").alias("c"),
                       F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))).alias("q"),
                       F.col(id_col).cast("long").alias("id"), F.transform(whole, lambda x: x).alias("v"))
    right = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("c"),
                                        F.pmod(spread, F.lit(query_cells)).cast("int").alias("q"),
                                        F.col(id_col).cast("long").alias("id"), whole.alias("v"))

    def arrays(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        ids, v = t.column("id").to_numpy(), t.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        sizes = np.diff(v.offsets.to_numpy())
        flat, at = v.values.to_numpy(), v.offsets.to_numpy()[:-1]
        return {int(d): (ids[sizes == d], flat[at[sizes == d][:, None] + np.arange(d)]) for d in np.unique(sizes)}

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: list = []
        if candidates.num_rows and queries.num_rows:
            ours, theirs = arrays(candidates), arrays(queries)
            for dims in ours.keys() & theirs.keys():
                found += search(*ours[dims], *theirs[dims], k)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), columns)})

    cut = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(
        run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
