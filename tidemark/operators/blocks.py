"""Ordered work on one key without putting the whole key into one task.

A window partitioned by symbol sends every row of a busy symbol to one task. Three building blocks
avoid that, and every tick-level operator is written on top of them:

`running`     prefix aggregates (sum, count, max, last) per key. Rows are grouped by (key, chunk),
              each chunk is scanned on its own, and the chunk totals - one row per chunk - carry
              the prefix from chunk to chunk.
`index_rows`  row numbers per key: `running` with a count.
`with_blocks` equal-size blocks of consecutive rows, each carrying a copy of the rows just before
              it (and after it) so that windows of bounded length are complete inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
HALO = "_halo"
CHUNK = "_chunk"


def time_chunk(ts: str, seconds: int) -> Column:
    """Fixed-length time slice number; the same for timestamps with and without zone."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


@dataclass(frozen=True)
class Order:
    """How the rows of a key follow each other: `by` is unique within a key, `chunk` monotone in it."""

    keys: tuple[str, ...]
    by: tuple[str, ...]
    chunk: Column
    reverse: bool = False


def ticks_order(keys: Sequence[str] = ("symbol",), ts: str = "ts", tie: str = "event_id",
                grain_seconds: int = 60) -> Order:
    return Order(tuple(keys), (ts, tie), time_chunk(ts, grain_seconds))


def running(df: DataFrame, order: Order, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add prefix aggregates up to and including each row.

    `totals` maps a new column to (kind, value); kind is sum, count, max or last (last non-null).
    """
    # Values are named columns: the chunk table and the row scan must see the same thing.
    base = df.withColumn(CHUNK, order.chunk)
    for name, (_, value) in totals.items():
        base = base.withColumn(f"_v_{name}", value)

    position = F.struct(*order.by)
    pick = F.min_by if order.reverse else F.max_by
    direction = (lambda c: F.col(c).desc()) if order.reverse else (lambda c: F.col(c).asc())

    aggregates = []
    for name, (kind, _) in totals.items():
        value = F.col(f"_v_{name}")
        if kind == "last":
            aggregates.append(pick(value, F.when(value.isNotNull(), position)).alias(f"_c_{name}"))
        else:
            aggregates.append(getattr(F, kind)(value).alias(f"_c_{name}"))
    chunks = base.groupBy(*order.keys, CHUNK).agg(*aggregates)

    before = (Window.partitionBy(*order.keys).orderBy(direction(CHUNK))
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = chunks.select(
        *order.keys, CHUNK,
        *[_combine(kind, F.col(f"_c_{name}")).over(before).alias(f"_p_{name}")
          for name, (kind, _) in totals.items()])

    inside = (Window.partitionBy(*order.keys, CHUNK).orderBy(*[direction(c) for c in order.by])
              .rowsBetween(Window.unboundedPreceding, 0))
    out = base.join(carried, [*order.keys, CHUNK])
    for name, (kind, _) in totals.items():
        prior, local = F.col(f"_p_{name}"), _local(kind, F.col(f"_v_{name}")).over(inside)
        out = out.withColumn(name, _merge(kind, prior, local))
    return out.drop(CHUNK, *[f"_{p}_{n}" for n in totals for p in ("v", "p")])


def _combine(kind: str, c: Column) -> Column:
    if kind == "last":
        return F.last(c, ignorenulls=True)
    return F.max(c) if kind == "max" else F.sum(c)


def _local(kind: str, c: Column) -> Column:
    return F.last(c, ignorenulls=True) if kind == "last" else getattr(F, kind)(c)


def _merge(kind: str, prior: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, prior)
    if kind == "max":
        return F.greatest(local, prior)
    return local if prior is None else F.coalesce(prior + local, local, prior)


def index_rows(df: DataFrame, order: Order, name: str = "rn") -> DataFrame:
    """Number the rows of each key from 1."""
    return running(df, order, {name: ("count", F.lit(1))})


def with_blocks(df: DataFrame, size: int, behind: int, ahead: int = 0, rn: str = "rn") -> DataFrame:
    """Assign rows to blocks of `size`; copy the neighbours each block needs and mark the copies."""
    pos = F.col(rn) - 1
    own = F.floor(pos / F.lit(size))
    first = F.greatest(F.floor((pos - ahead) / F.lit(size)), F.lit(0))
    last = F.floor((pos + behind) / F.lit(size))
    return (df.withColumn("_own", own)
            .withColumn(BLOCK, F.explode(F.sequence(first, last)))
            .withColumn(HALO, F.col(BLOCK) != F.col("_own"))
            .drop("_own"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into the configured number of shuffle partitions, and keep that number.

    For work that is heavy for its bytes: adaptive execution merges partitions by size alone. The
    grouping or window that follows on the same keys needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def block_window(keys: Sequence[str], rn: str = "rn") -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(rn)


def trailing(w: WindowSpec, k: int) -> WindowSpec:
    """The current row and the k-1 before it."""
    return w.rowsBetween(-(k - 1), 0)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the copied rows and the block marks."""
    return df.where(~F.col(HALO)).drop(BLOCK, HALO)
