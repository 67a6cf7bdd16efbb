"""Candles, first-seen de-duplication, the logical clock, latest values and reports per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tidemark.operators.ranges import per_range, ranged


def candles(ticks: DataFrame, duration: str = "60 seconds", keys: tuple[str, ...] = ("symbol",),
            ts: str = "ts", tie: str = "event_id", price: str = "mid") -> DataFrame:
    """Open, high, low, close and volume per tumbling event-time window.

    One aggregate with map-side partials, so a busy symbol costs no more than its windows.
    """
    at = F.struct(F.col(ts), F.col(tie))
    # A cast would hide the watermark of a stream.
    time = F.col(ts) if ticks.schema[ts].dataType == TimestampType() else F.col(ts).cast("timestamp")
    out = ticks.groupBy(*keys, F.window(time, duration).alias("_w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.sum("volume").alias("volume"))
    return out.withColumn("t", F.unix_seconds(F.col("_w.start"))).drop("_w")


def latest_rows(df: DataFrame, keys: tuple[str, ...], by: list[Column], n: int) -> DataFrame:
    """The n rows of each key that come first in `by`; Spark cuts each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_seen(df: DataFrame, key: str | list[str], by: list[str]) -> DataFrame:
    """One row per key, the earliest in `by`. An aggregate: a key repeated without end stays cheap."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def logical_clock(df: DataFrame, ts: str = "ts", arrival: str = "event_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Logical time t = max(t, received) + 1 in arrival order, as a prefix count and a prefix maximum.

    After n events t_n = n + max(0, max over k <= n of (received_k - k + 1)). Rows are dealt to ranges of their
    arrival once; a table of one row per range carries number and maximum on, so it matters neither how far the arrival
    numbers lie apart nor whether there are keys.
    """
    received = F.pmod(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1000)).cast("long"), F.lit(2 ** 48))
    ahead = F.col("_r") - F.col("_row")
    rows = ranged(df.withColumn("_r", received), list(keys), [arrival])
    parts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"), F.max(ahead).alias("_m"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    carried = shift.withColumn("_before", F.max(F.col("_m") - F.col("_shift")).over(before))
    inside = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = per_range(rows.withColumn("_l", F.max(ahead).over(inside)), carried, list(keys), ["_shift", "_before"])
    most = F.greatest(F.col("_l") - F.col("_shift"), F.col("_before"), F.lit(0))
    return out.withColumn("logical_t", F.col("_row") + F.col("_shift") + 1 + most).select(*df.columns, "logical_t")


def event_counts(df: DataFrame, kind: str = "type") -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def latest_snapshot(df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], cols: list[str]) -> DataFrame:
    """The newest values of each key in one aggregate."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(*by)).alias("_row")).select(*keys, "_row.*")


def dedup_by_max(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last row per key in `seq` order, by aggregate."""
    others = [c for c in df.columns if c not in keys and c != seq]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row"))
            .select(*keys, "_row.*"))
