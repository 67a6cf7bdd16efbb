"""Cosine top-k: pattern memory and analogue retrieval, both exact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot, unit
from tidemark.operators.blocks import spread
from tidemark.operators.robust import apply_scaler, fit_scaler

CELL_ROWS, CELL_QUERIES = 200_000, 2_000


def top_k_similar(queries: DataFrame, memory: DataFrame, k: int = 5, query_id: str = "query_id",
                  memory_id: str = "vec_id", vector: str = "vector", cell_rows: int = CELL_ROWS,
                  cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The k memory rows with the highest cosine for each query: (query_id, memory_id, similarity, rank).

    Both sides are cut into cells by id hash. A task multiplies one block of queries with one block of
    memory and keeps k rows per query, so pairs are never stored and no side must fit in one place.
    """
    groups = max(1, math.ceil(queries.count() / cell_queries))
    cells = max(1, math.ceil(memory.count() / cell_rows))

    def parts(name: str, n: int):
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("qv"), parts(query_id, groups).alias("g"))
    q = q.withColumn("c", every(cells))
    m = memory.select(F.col(memory_id).alias("m"), F.col(vector).alias("mv"), parts(memory_id, cells).alias("c"))
    m = m.withColumn("g", every(groups))

    def cell(left, right):
        import numpy as np
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "m": [], "similarity": [], "c": []})
        a = np.stack(left["qv"].to_numpy()).astype(np.float64)
        b = np.stack(right["mv"].to_numpy()).astype(np.float64)
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        ids = right["m"].to_numpy()
        by_id = np.argsort(ids, kind="stable")  # ties go to the smaller id
        ids, b = ids[by_id], b[by_id]
        out = []
        for start in range(0, len(a), 256):
            sims = a[start:start + 256] @ b.T
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            names = np.repeat(left["q"].to_numpy()[start:start + 256], best.shape[1])
            out.append(pd.DataFrame({"q": names, "m": ids[best].ravel(),
                                     "similarity": np.take_along_axis(sims, best, 1).ravel(),
                                     "c": int(right["c"].iloc[0])}))
        return pd.concat(out)

    types = {f.name: f.dataType.simpleString() for f in (*q.schema, *m.schema)}
    q, m = spread(q, "g", "c"), spread(m, "g", "c")
    best = q.groupBy("g", "c").cogroup(m.groupBy("g", "c")).applyInPandas(
        cell, f"q {types['q']}, m {types['m']}, similarity double, c int")
    by = [F.desc("similarity"), F.asc("m")]
    for part in (["q", F.pmod(F.col("c"), F.lit(64))], ["q"]):
        w = Window.partitionBy(*part).orderBy(*by)
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("m").alias(memory_id), "similarity", "rank")


def pattern_rows(ticks: DataFrame, context: str, horizon: int, order) -> DataFrame:
    """Pattern-memory rows of ticks whose horizon has passed: unit context, realised log return, label, time.

    Expects numbered ticks with a context array (and a regime column, if known).
    """
    from tidemark.operators.align import tick_horizon

    out = tick_horizon(ticks, (horizon,), order).where(F.col(f"realised_{horizon}").isNotNull())
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").cast("string")
    regime = F.col("regime") if "regime" in ticks.columns else F.lit(None).cast("string")
    keep = [c for c in ("event_id", *order.keys) if c in ticks.columns]
    return out.select(*keep, unit(F.col(context)).alias("vector"), F.concat(F.lit("t="), seconds).alias("label"),
                      F.col(f"realised_{horizon}").alias("outcome"), regime.alias("regime"), "ts")


REGIME_COLUMNS = ("vix_close", "cot_mm_net_z", "gld_flow_5d_z")


def fit_index_scaler(panel: DataFrame, features: list[str], label: str) -> DataFrame:
    return fit_scaler(indexable(panel, features, label), features)


def indexable(panel: DataFrame, features: list[str], label: str) -> DataFrame:
    return panel.where(F.col(label).isNotNull()).where(F.coalesce(*[F.col(c).cast("double") for c in features]).isNotNull())


def scaled_vector(rows: DataFrame, features: list[str], scaler: DataFrame, keep: list[str]) -> DataFrame:
    """Scale, clip and normalise the features of each row into one unit array."""
    kept = rows.select(*[F.col(c).alias(f"_k_{c}") for c in keep], *features)
    # The vector comes first: a kept column may bear the name of a feature.
    scaled = apply_scaler(kept, features, scaler).withColumn("vector", unit(F.array(*features)))
    return scaled.select(*[F.col(f"_k_{c}").alias(c) for c in keep], "vector")


def build_index(panel: DataFrame, features: list[str], label: str, scaler: DataFrame | None = None) -> DataFrame:
    """Analogue index: date, unit vector, close, realised return and regime columns of labelled days."""
    rows = indexable(panel, features, label)
    scaler = scaler if scaler is not None else fit_scaler(rows, features)
    keep = ["date", "gold_close", label, *[c for c in REGIME_COLUMNS if c in panel.columns]]
    return scaled_vector(rows, features, scaler, keep).withColumnRenamed(label, "target_logret")


def retrieve(index: DataFrame, query: DataFrame, k: int = 10, newest: str | None = None,
             bands: dict[str, tuple[float, float]] | None = None, condition: Column | None = None,
             keys: tuple[str, ...] = ()) -> DataFrame:
    """The k most similar days to each query vector, best first; `keys` are query columns to keep in front.

    newest: last admissible date (the query date minus the exclusion gap). bands: {column: (low, high)};
    columns the index lacks are ignored. condition: any test over index columns and those of the query
    row, which are prefixed with `_q_`. Query rows are told apart by all their columns; the set is sent to every
    task, so it has to be a few rows, as asked for by a user (`top_k_similar` is for large sets).
    """
    rows = index.where(F.col("date") <= F.lit(newest).cast("date")) if newest else index
    one = query.select(F.col("vector").alias("_q"), *[F.col(c).alias(f"_q_{c}") for c in query.columns if c != "vector"])
    j = rows.crossJoin(F.broadcast(one.distinct()))
    for col, (lo, hi) in (bands or {}).items():
        if col in index.columns:
            j = j.where(F.col(col).between(lo, hi))
    if condition is not None:
        j = j.where(condition)
    cols = [c for c in index.columns if c != "vector"]
    best = Window.partitionBy(*one.columns).orderBy(F.desc("similarity"), "date")
    ranked = j.withColumn("similarity", dot(F.col("vector"), F.col("_q"))).withColumn("_rank", F.row_number().over(best))
    return ranked.where(F.col("_rank") <= k).orderBy(*[f"_q_{c}" for c in keys], "_rank").select(
        *[F.col(f"_q_{c}").alias(c) for c in keys], *cols, "similarity")


def outcome_summary(hits: DataFrame) -> DataFrame:
    """Distribution of the realised returns of retrieved days."""
    r = F.col("target_logret")
    return hits.agg(
        F.count("*").alias("n"), F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"),
        F.stddev_pop(r).alias("std"), F.avg((r > 0).cast("int")).alias("p_up"),
        F.percentile(r, F.lit(0.1)).alias("q10"), F.percentile(r, F.lit(0.9)).alias("q90"),
        F.avg("similarity").alias("avg_sim"))


def write_index(index: DataFrame, scaler: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(f"{path}/vectors")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/scaler")
