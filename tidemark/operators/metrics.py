"""Forecast and return metrics as aggregate expressions and grouped frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import QUANTILES, d, pinball
from tidemark.operators.robust import quantiles


def hit_rate(y: Column, p: Column) -> Column:
    """Share of equal signs among pairs where both are known; null if there are none."""
    return F.avg((F.signum(y) == F.signum(p)).cast("int"))


def sharpe(r: Column, per_year: float = 252.0) -> Column:
    sd = F.stddev_pop(r)
    return F.when(sd >= 1e-12, F.avg(r) / sd * (per_year ** 0.5)).when(sd.isNotNull(), d(0))


def mean_pinball(y: Column, q: Column, tau: float) -> Column:
    return F.avg(pinball(y, q, tau))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(y.between(lo, hi).cast("int"))


def newey_west_sharpe(df: DataFrame, ret: str, order: str, by: list[str] = (), lag: int = 20,
                      per_year: float = 252.0, name: str = "sharpe_nw") -> DataFrame:
    """Sharpe ratio with a Bartlett-weighted long-run variance.

    One row per day and group goes in, so a group is bounded by the calendar; the autocovariances come
    from lagged columns of one window.
    """
    by = list(by)
    group = Window.partitionBy(*by, F.lit(0))
    w = group.orderBy(order)
    rows = df.where(F.col(ret).isNotNull()).withColumn("_e", F.col(ret) - F.avg(ret).over(group))
    rows = rows.withColumns({f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lag + 1)})
    n = F.count("*")
    hac = F.sum(F.col("_e") * F.col("_e")) / n
    for k in range(1, lag + 1):
        hac = hac + 2.0 * (1.0 - k / (lag + 1.0)) * F.coalesce(F.sum(f"_p{k}"), d(0)) / n
    flat = (n < lag + 2) | (F.stddev_pop(ret) < 1e-12)
    value = F.avg(ret) / F.sqrt(F.greatest(hac, d(1e-12))) * (per_year ** 0.5)
    return rows.groupBy(*by).agg(F.when(flat, d(0)).otherwise(value).alias(name))


def nonoverlap_sharpe(df: DataFrame, ret: str, order: str, horizon: int, by: list[str] = ()) -> DataFrame:
    """Sharpe ratio of every horizon-th row, annualised by the number of such periods."""
    w = Window.partitionBy(*by, F.lit(0)).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % horizon == 0)
    return rows.groupBy(*by).agg(sharpe(F.col(ret), 252.0 / horizon).alias("sharpe_nonoverlap"))


def by_tertile(df: DataFrame, regime: str, ret: str, y: str, p: str, by: list[str] = (), least: int = 5) -> DataFrame:
    """Metrics per tertile of a regime column; buckets with fewer than `least` rows are left out."""
    by = list(by)
    rows = df.where(F.col(regime).isNotNull())
    cuts = quantiles(rows, [regime], [1 / 3, 2 / 3], by).withColumnRenamed(regime, "_t")
    j = rows.join(cuts, by) if by else rows.crossJoin(F.broadcast(cuts))
    x = F.col(regime)
    bucket = F.when(x <= F.get("_t", 0), "low").when(x <= F.get("_t", 1), "mid").otherwise("high")
    return j.groupBy(*by, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), hit_rate(F.col(y), F.col(p)).alias("hit"), sharpe(F.col(ret)).alias("sharpe"),
        F.avg(ret).alias("mean_r")).where(F.col("n") >= least)


def mixed(x: np.ndarray) -> np.ndarray:
    """Integers below 2^32 hashed by shifts and a multiplication, which any SQL engine can repeat."""
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)
    return (x >> np.uint64(16)) ^ x


def resampled_rows(draws: np.ndarray, n: int, p: float, seed: int) -> np.ndarray:
    """[draws, n] row numbers of stationary-bootstrap samples: a new block begins with probability p.

    Numbers come from (seed, draw, position) alone, so a sample is the same wherever and with whatever it is drawn.
    """
    pos = np.arange(n, dtype=np.uint64)
    key = mixed((np.uint64(seed % 4096 << 20) + draws.astype(np.uint64)) & np.uint64(0xFFFFFFFF))
    u = mixed(key[:, None] ^ pos)
    fresh = u < np.uint64(p * 2 ** 32)
    fresh[:, 0] = True
    starts = (mixed(u ^ np.uint64(0x9E3779B9)) % np.uint64(n)).astype(np.int64)
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    return (np.take_along_axis(starts, at, 1) + np.arange(n) - at) % n


def bootstrap_sharpe(df: DataFrame, ret: str, order: str, by: list[str] = (), n_boot: int = 1000, p: float = 0.1,
                     per_year: float = 252.0, seed: int = 0, batch: int = 50) -> DataFrame:
    """Stationary-bootstrap Sharpe ratio: median and 95 % interval per group.

    A group's returns (one per day) travel as one array to each batch of resamples. Under 30 rows: plain ratio.
    """
    by = list(by)
    series = df.where(F.col(ret).isNotNull()).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ret).alias("r")))),
                    lambda s: s["r"]).alias("r"))
    n_batches = -(-n_boot // batch)
    jobs = series.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
    jobs = jobs.repartition(*by, "b")

    def resample(frames):
        for pdf in frames:
            sharpes = []
            for r, b in zip(pdf["r"], pdf["b"]):
                r = np.asarray(r, dtype=np.float64)
                if len(r) < 30:
                    sd = r.std()
                    sharpes.append([float(r.mean() / sd * per_year ** 0.5) if sd >= 1e-12 else 0.0])
                    continue
                draws = np.arange(int(b) * batch, min(n_boot, (int(b) + 1) * batch))
                sample = r[resampled_rows(draws, len(r), p, seed)]
                sd = sample.std(axis=1)
                ratio = np.where(sd > 1e-12, sample.mean(axis=1) / np.maximum(sd, 1e-300), 0.0)
                sharpes.append((ratio * per_year ** 0.5).tolist())
            yield pdf.drop(columns=["r"]).assign(s=sharpes)

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in series.schema if f.name in by)
    draws = jobs.mapInPandas(resample, f"{keys}b int, s array<double>").select(*by, F.explode("s").alias("s"))
    q = F.percentile("s", F.array(d(0.5), d(0.025), d(0.975)))
    return draws.groupBy(*by).agg(q.alias("q")).select(
        *by, F.get("q", 0).alias("sharpe_med"), F.get("q", 1).alias("sharpe_lo"), F.get("q", 2).alias("sharpe_hi"))


def loss_report(df: DataFrame, y: str = "y", mu: str = "mu", log_var: str = "log_var", bands: list[str] | None = None,
                lam: float = 0.0, by: list[str] = ()) -> DataFrame:
    """Mean pinball over the five quantiles, Gaussian likelihood, direction hinge and their weighted sum."""
    bands = bands or ["q10", "q25", "q50", "q75", "q90"]
    target = F.col(y)
    pin = sum((pinball(target, F.col(c), t) for c, t in zip(bands, QUANTILES)), d(0)) / len(bands)
    err = target - F.col(mu)
    nll = 0.5 * (F.col(log_var) + err * err * F.exp(-F.col(log_var)))
    hinge = F.greatest(-F.col(mu) * target, d(0))
    out = df.groupBy(*by).agg(F.avg(pin).alias("pinball"), F.avg(nll).alias("nll"), F.avg(hinge).alias("direction"))
    return out.withColumn("total", F.col("pinball") + 0.3 * F.col("nll") + 0.1 * F.col("direction") + 0.02 * abs(lam))
