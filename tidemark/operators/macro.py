"""Macro releases: surprise against the recent past of the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def surprise(df: DataFrame, keys: tuple[str, ...] = ("series_id",), at: str = "date", value: str = "value",
             given: str | None = None, history: int = 12) -> DataFrame:
    """(value - mean) / (population sd + 1e-8) of the up to 12 values before, once two are known.

    A release that brings its own surprise keeps it and does not enter the history of others. A
    series has one row per release date, so the window is bounded by the calendar.
    """
    own = F.col(given) if given else F.lit(None).cast("double")
    counts = own.isNull() & F.col(value).isNotNull()
    rows = df.withColumn("_hist", counts)
    w = Window.partitionBy(*keys, "_hist").orderBy(at).rowsBetween(-history, -1)
    x = F.col(value)
    z = (x - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8)
    computed = F.when(F.col("_hist") & (F.count(value).over(w) >= 2), z)
    return rows.withColumn("surprise", F.coalesce(own, computed)).drop("_hist")
