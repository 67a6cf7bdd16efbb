"""Robust statistics: rolling median/MAD z-scores, scaler and winsoriser fits, and their application.

Fits are one-row frames; applying them attaches that row by broadcast, which is bounded by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import MAD_SIGMA, clip, clip_between, d, ratio
from tidemark.session import write_through


def min_periods(window: int) -> int:
    return max(20, window // 4)


def _guarded(x: Column, agg: Column, frame: WindowSpec, need: int) -> Column:
    return F.when(F.count(x).over(frame) >= need, agg.over(frame))


def rolling_median(x: Column, frame: WindowSpec, need: int) -> Column:
    return _guarded(x, F.percentile(x, F.lit(0.5)), frame, need)


def rolling_mean(x: Column, frame: WindowSpec, need: int) -> Column:
    return _guarded(x, F.avg(x), frame, need)


def robust_z(df: DataFrame, columns: dict[str, str], order: WindowSpec, window: int) -> DataFrame:
    """Add rolling z columns {source: target}: (x - median) / (1.4826 * MAD), each deviation taken
    from the median of its own day. For daily frames, where a partition is bounded by the calendar."""
    frame, need = order.rowsBetween(-(window - 1), 0), min_periods(window)
    out = df.withColumns({f"_med_{t}": rolling_median(F.col(s), frame, need) for s, t in columns.items()})
    out = out.withColumns({f"_dev_{t}": F.abs(F.col(s) - F.col(f"_med_{t}")) for s, t in columns.items()})
    out = out.withColumns({f"_mad_{t}": rolling_median(F.col(f"_dev_{t}"), frame, need) for t in columns.values()})
    out = out.withColumns({t: ratio(F.col(s) - F.col(f"_med_{t}"), F.col(f"_mad_{t}") * MAD_SIGMA)
                           for s, t in columns.items()})
    return out.drop(*[f"_{p}_{t}" for t in columns.values() for p in ("med", "dev", "mad")])


def quantiles(df: DataFrame, cols: list[str], levels: list[float], by: list[str] = (), accuracy: int = 10_000
              ) -> DataFrame:
    """Exact interpolated quantiles of columns for each group `by`: one array per column, null without any value.

    A sketch per group, whose size `accuracy` bounds, gives a range of values around each wanted rank; a second pass
    counts what lies below and orders only the values inside, some 4 / accuracy of the rows, equal ones counted
    together before they are shuffled. The nearest value on either side belongs to the range, so small groups are
    exact too. Nulls are left out, a null key is a group. `df` is read twice.
    """
    by, cells = list(by), [(i, j) for i in range(len(cols)) for j in range(len(levels))]
    margin = 2.0 / accuracy
    ends = [min(max(q + m, 0.0), 1.0) for q in levels for m in (-margin, margin)]
    x = [F.col(c).cast("double") for c in cols]
    sketch = df.groupBy(*by).agg(*[F.percentile_approx(c, ends, accuracy).alias(f"_s{i}") for i, c in enumerate(x)],
                                 *[F.count(c).alias(f"_n{i}") for i, c in enumerate(x)])
    sketch = sketch.withColumnsRenamed({c: f"_by{k}" for k, c in enumerate(by)})
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    rows = df.join(sketch, same) if by else df.crossJoin(F.broadcast(sketch))  # one row
    keys = [f"_by{k}" for k in range(len(by))]
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x[i].alias("x"), F.col(f"_n{i}").alias("total"),
                                 F.get(f"_s{i}", 2 * j).alias("lo"), F.get(f"_s{i}", 2 * j + 1).alias("hi")) for i, j in cells])
    rows = rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*").where(F.col("x").isNotNull())
    side = F.when(F.col("x") < F.col("lo"), -1).when(F.col("x") > F.col("hi"), 1).otherwise(0)
    cell = [*keys, "i", "j"]
    held = rows.withColumn("side", side).withColumn("value", F.when(F.col("side") == 0, F.col("x"))) \
        .groupBy(*cell, "total", "side", "value").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    upto = F.sum("n").over(Window.partitionBy(*cell).orderBy("side", "value"))
    # Below the range only the last rank has a known value, above it only the first.
    held = held.withColumn("end", upto).select(
        *cell, "total", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")).alias("x"),
        F.when(F.col("side") < 0, F.col("end") - 1).otherwise(F.col("end") - F.col("n")).alias("from"),
        F.when(F.col("side") > 0, F.col("end") - F.col("n") + 1).otherwise(F.col("end")).alias("to"))
    pos = (F.col("total") - 1) * F.element_at(F.array(*[d(q) for q in levels]), F.col("j") + 1)
    at = lambda rank: F.max(F.when((F.col("from") <= rank) & (rank < F.col("to")), F.col("x")))
    points = held.withColumn("pos", pos).groupBy(*cell).agg(
        at(F.floor("pos")).alias("a"), at(F.ceil("pos")).alias("b"), F.max(F.col("pos") - F.floor("pos")).alias("t"))
    lost = F.col("a").isNull() | F.col("b").isNull()
    value = F.when(lost, F.raise_error(F.lit("a rank lies outside its sketched range")).cast("double")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * F.col("t"))
    found = points.withColumn("v", value).groupBy(*keys).agg(*[
        F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))).alias(f"_v{i}_{j}") for i, j in cells])
    arrays = [F.when(F.col(f"_v{i}_0").isNotNull(), F.array(*[F.col(f"_v{i}_{j}") for j in range(len(levels))])).alias(c)
              for i, c in enumerate(cols)]
    if not by:
        return found.select(*arrays)
    groups = sketch.select(*[F.col(k).alias(f"_g{k}") for k in keys])  # those without any value as well
    out = groups.join(found, [F.col(f"_g{k}").eqNullSafe(F.col(k)) for k in keys], "left")
    return out.select(*[F.col(f"_g_by{k}").alias(c) for k, c in enumerate(by)], *arrays)


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per feature: median and MAD sigma (1 where the MAD vanishes). Nulls count as zero."""
    x = df.select(*[F.coalesce(F.col(c).cast("double"), d(0)).alias(c) for c in cols])
    med = quantiles(x, cols, [0.5]).select(*[F.get(c, 0).alias(f"_m_{c}") for c in cols])
    med = write_through(med, "medians")  # one row, read three times
    dev = x.crossJoin(F.broadcast(med)).select(*[F.abs(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
    mad = quantiles(dev, cols, [0.5]).select(*[F.get(c, 0).alias(c) for c in cols])
    both = mad.crossJoin(F.broadcast(med))
    return _per_feature(both, cols, lambda c: {
        "med": F.col(f"_m_{c}"),
        "mad": F.when(F.col(c) * MAD_SIGMA < 1e-8, d(1)).otherwise(F.col(c) * MAD_SIGMA)})


def fit_winsor(df: DataFrame, cols: list[str], lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """One row per feature: clipping bounds; a constant feature gets a sliver of width. Nulls count as zero."""
    x = df.select(*[F.coalesce(F.col(c).cast("double"), d(0)).alias(c) for c in cols])
    q = quantiles(x, cols, [lo, hi])
    return _per_feature(q, cols, lambda c: {
        "lo": F.get(c, 0),
        "hi": F.when(F.get(c, 1) <= F.get(c, 0), F.get(c, 0) + 1e-6).otherwise(F.get(c, 1))})


def _per_feature(one_row: DataFrame, cols: list[str], values) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("feature"), *[v.alias(n) for n, v in values(c).items()]) for c in cols]
    return one_row.select(F.explode(F.array(*entries)).alias("f")).select("f.*")


def _as_row(fit: DataFrame, cols: list[str], names: tuple[str, ...], prefix: str) -> DataFrame:
    return fit.where(F.col("feature").isin(cols)).groupBy().agg(*[
        F.max(F.when(F.col("feature") == c, F.col(n))).alias(f"{prefix}{n}_{c}") for c in cols for n in names])


def apply_winsor(df: DataFrame, cols: list[str], fit: DataFrame) -> DataFrame:
    row = _as_row(fit, cols, ("lo", "hi"), "_w")
    out = df.crossJoin(F.broadcast(row)).withColumns({
        c: clip_between(F.coalesce(F.col(c).cast("double"), d(0)), F.col(f"_wlo_{c}"), F.col(f"_whi_{c}"))
        for c in cols})
    return out.drop(*row.columns)


def apply_scaler(df: DataFrame, cols: list[str], fit: DataFrame, bound: float = 8.0) -> DataFrame:
    """Null to zero, centre, scale, clip."""
    row = _as_row(fit, cols, ("med", "mad"), "_s")
    out = df.crossJoin(F.broadcast(row)).withColumns({
        c: clip((F.coalesce(F.col(c).cast("double"), d(0)) - F.col(f"_smed_{c}")) / F.col(f"_smad_{c}"), -bound, bound)
        for c in cols})
    return out.drop(*row.columns)


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of non-null values per column, one row per column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in cols])
    return _per_feature(one, cols, lambda c: {"coverage": F.col(c)})


def latest_robust_z(df: DataFrame, value: str, at: str, n: int, need: int, sum_rows: int = 1,
                    keys: tuple[str, ...] = ()) -> DataFrame:
    """Robust z of the newest value against the newest `n` values of a key, rounded to 2 digits.

    With sum_rows > 1, values are held newest first and summed over that many consecutive ones before.
    Null if fewer than `need` rows (or 5 values) exist, zero if the MAD vanishes.
    """
    w = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc(at))
    last = df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    # The newest element of the rolled sums is the sum ending `sum_rows` rows back in newest-first order.
    rolled = F.sum(value).over(w.rowsBetween(-(sum_rows - 1), 0))
    x = last.withColumn("_x", F.when(F.col("_k") >= sum_rows, rolled))
    stats = x.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count("_x").alias("_nx"), F.percentile("_x", F.lit(0.5)).alias("_med"),
        F.max(F.when(F.col("_k") == sum_rows, F.col("_x"))).alias("_new"))
    both = x.join(stats, list(keys)) if keys else x.crossJoin(F.broadcast(stats))
    out = both.groupBy(*keys, "_n", "_nx", "_med", "_new").agg(
        (F.percentile(F.abs(F.col("_x") - F.col("_med")), F.lit(0.5)) * MAD_SIGMA).alias("_mad"))
    z = F.when(F.col("_mad") < 1e-12, d(0)).otherwise((F.col("_new") - F.col("_med")) / F.col("_mad"))
    ok = (F.col("_n") >= need) & (F.col("_nx") >= 5)
    return out.select(*keys, F.round(F.when(ok, z), 2).alias("z"))
