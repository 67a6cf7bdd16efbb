"""Row numbers over the whole order of a key, however many of the rows it holds: range partitions, counted and offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import write_through


def ranged(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "ranges") -> DataFrame:
    """`df` sorted by `keys` and `order` into range partitions, written once; `_part` is the partition, `_row` the place.

    One exchange. Rows that are equal in all of these columns are dealt to neighbouring partitions as well, so neither a
    hot key nor a hot moment ends in one task. `_row` grows with the order within a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*keys, *order, "_tie"]
    cut = tie.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie")
    return write_through(cut.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)


def per_range(rows: DataFrame, parts: DataFrame, keys: list[str], add: list[str]) -> DataFrame:
    """`rows` of `ranged` with columns of a table that has one row per key and partition; null is a key of its own."""
    of = parts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of"), *add)
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(of, same)


def ranged_running(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Prefix aggregates up to and including each row, in the order of a key's rows over range partitions.

    `totals` maps a new column to (kind, value); kind is sum, count, max or last (last non-null). Partitions are chunks
    of equal size whatever the keys, the moments or the numbers of the rows are; one row per key and partition carries
    the prefix on. The rows are exchanged once, written, and read by the same ranges.
    """
    values = df.withColumns({f"_v_{name}": value for name, (_, value) in totals.items()})
    rows = ranged(values, keys, order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    position = F.col("_row")
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    parts = rows.groupBy(*keys, "_part").agg(*[
        (F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), position)) if kind == "last"
         else getattr(F, kind)(f"_v_{name}")).alias(f"_c_{name}") for name, (kind, _) in totals.items()])
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumns({f"_p_{name}": merge[kind](F.col(f"_c_{name}")).over(before) for name, (kind, _) in totals.items()})
    inside = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.repartitionByRange(n, "_part").withColumns({
        f"_l_{name}": (merge["last"](F.col(f"_v_{name}")) if kind == "last" else getattr(F, kind)(f"_v_{name}")).over(inside)
        for name, (kind, _) in totals.items()})
    out = per_range(local, carried, keys, [f"_p_{name}" for name in totals])
    for name, (kind, _) in totals.items():
        here, prior = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        out = out.withColumn(name, F.coalesce(here, prior) if kind == "last" else F.greatest(here, prior) if kind == "max"
                             else F.coalesce(here + prior, here, prior))
    return out.select(*df.columns, *totals)


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], place: str = "place", total: str = "total") -> DataFrame:
    """`df` with the 0-based place of each row in its key's order, and the rows of the key; null is a key of its own.

    Beside the rows only one row per key and partition is handled, so a key of any size is numbered in parallel.
    """
    rows = ranged(df, keys, order)
    parts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.withColumns({"_shift": before - F.col("_first"), total: F.sum("_n").over(key)})
    return per_range(rows, shifts, keys, ["_shift", total]).withColumn(place, F.col("_row") + F.col("_shift")) \
        .select(*df.columns, place, total)
