"""Time-varying Granger weights per edge (cause -> effect) on rolling windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import BLOCK, HALO, Order, index_rows, own_rows, spread, with_blocks
from tidemark.operators.ticks import ema

# Edges into gold and how fast each weight follows.
EDGE_SPEED = {"SENTIMENT": 0.20, "VIX": 0.18, "USD": 0.12, "DXY": 0.12, "YIELDS": 0.10, "OIL": 0.10, "FED": 0.06,
              "INFLATION": 0.06}


def _residuals(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    design = np.column_stack([np.ones(len(y)), *columns])
    return y - design @ np.linalg.lstsq(design, y, rcond=None)[0]


def _lags(v: np.ndarray, lag: int) -> list[np.ndarray]:
    return [v[lag - k:len(v) - k] for k in range(1, lag + 1)]


def best_lag(x: np.ndarray, y: np.ndarray, longest: int = 6) -> int:
    """Lag order with the smallest Bayesian information criterion."""
    scores = {}
    for lag in range(1, min(longest + 1, len(y) // 4)):
        res = _residuals(_lags(y, lag) + _lags(x, lag), y[lag:])
        rows = len(res)
        scores[lag] = rows * np.log(res @ res / rows + 1e-12) + (2 * lag + 1) * np.log(rows)
    return min(scores, key=scores.get) if scores else 1


def granger_weight(x: np.ndarray, y: np.ndarray, lag: int, cdf=None) -> float:
    """How much past changes of x help to predict changes of y, in [0, 1]; 0.5 when undecided.

    The F statistic becomes a weight by the F distribution if `cdf(f, lag, dof)` is given, else by a
    logistic curve; common movement of the squared residuals adds up to 0.14.
    """
    dx, dy = np.diff(x), np.diff(y)
    if len(dy) <= 2 * lag + 5:
        return 0.5
    target = dy[lag:]
    own = _residuals(_lags(dy, lag), target)
    both = _residuals(_lags(dy, lag) + _lags(dx, lag), target)
    rss_own, rss_both = own @ own, both @ both
    if min(rss_own, rss_both) < 1e-12:
        return 0.5
    dof = max(len(target) - 2 * lag - 1, 1)
    f = (rss_own - rss_both) / lag / (rss_both / dof)
    if f <= 0:
        return 0.5
    weight = float(cdf(f, lag, dof)) if cdf else 1.0 / (1.0 + np.exp(-(f - 2.0)))
    a, b = own ** 2, both ** 2
    if a.std() > 1e-8 and b.std() > 1e-8:
        weight += max(0.0, abs(np.corrcoef(a, b)[0, 1]) - 0.3) * 0.20
    return float(np.clip(weight, 0.0, 1.0))


def _batch_residuals(columns: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares residuals of many small problems at once, and which of them are well conditioned."""
    design = np.stack([np.ones_like(y), *columns], axis=2)
    normal = design.transpose(0, 2, 1) @ design
    eig = np.linalg.eigvalsh(normal)
    sound = eig[:, 0] > 1e-10 * eig[:, -1]
    normal[~sound] = np.eye(normal.shape[1])
    beta = np.linalg.solve(normal, design.transpose(0, 2, 1) @ y[:, :, None])
    return y - (design @ beta)[:, :, 0], sound


def batch_weights(x: np.ndarray, y: np.ndarray, lag: int) -> np.ndarray:
    """`granger_weight` (logistic form) for the rows of two matrices of equal windows; nan where a window's
    regressions are ill conditioned and need the exact solver."""
    dx, dy = np.diff(x, axis=1), np.diff(y, axis=1)
    n = dy.shape[1]
    if n <= 2 * lag + 5:
        return np.full(len(x), 0.5)
    target = dy[:, lag:]
    own_lags = [dy[:, lag - k:n - k] for k in range(1, lag + 1)]
    own, ok = _batch_residuals(own_lags, target)
    both, ok_too = _batch_residuals(own_lags + [dx[:, lag - k:n - k] for k in range(1, lag + 1)], target)
    a, b = own ** 2, both ** 2
    rss_own, rss_both = a.sum(axis=1), b.sum(axis=1)
    with np.errstate(all="ignore"):
        f = (rss_own - rss_both) / lag / (rss_both / max(target.shape[1] - 2 * lag - 1, 1))
        weight = 1.0 / (1.0 + np.exp(-(f - 2.0)))
        sa, sb = a.std(axis=1), b.std(axis=1)
        corr = ((a - a.mean(axis=1, keepdims=True)) * (b - b.mean(axis=1, keepdims=True))).mean(axis=1) / (sa * sb)
        boost = np.where((sa > 1e-8) & (sb > 1e-8), np.maximum(0.0, np.abs(corr) - 0.3) * 0.20, 0.0)
    out = np.clip(weight + boost, 0.0, 1.0)
    out[(np.minimum(rss_own, rss_both) < 1e-12) | ~(f > 0)] = 0.5
    out[~(ok & ok_too)] = np.nan
    return out


def granger_weights(pairs: DataFrame, order: Order, window: int = 120, base_lag: int = 3, refresh: int = 50,
                    size: int = 1024, cause: str = "cause", longest: int = 6) -> DataFrame:
    """Raw and smoothed weight per row of an edge's paired series.

    `pairs` has the edge keys (of which `cause` decides the smoothing speed), order columns, x (cause), y (effect). Every
    row is one update on the last `window` pairs; the lag order, up to `longest`, is chosen anew at each multiple of
    `refresh`. Blocks carry the pairs both need, so edges and stretches of time run in parallel.
    """
    need = base_lag + 15
    numbered = index_rows(pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()), order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema) + ", weight double"
    columns = numbered.columns

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable").reset_index(drop=True)
        x, y, rn = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), pdf["rn"].to_numpy()
        weights = np.full(len(pdf), np.nan)

        def tail(i: int) -> slice:
            return slice(max(0, i + 1 - window), i + 1)

        own = ~pdf[HALO].to_numpy() & (rn >= need)
        chosen = np.maximum(need, rn // refresh * refresh)
        for at in np.unique(chosen[own]):
            rows = np.flatnonzero(own & (chosen == at))
            first = tail(rows[0] - int(rn[rows[0]] - at))
            lag = best_lag(x[first], y[first], longest)
            full = rows[rows >= window - 1]
            if len(full):
                take = full[:, None] + np.arange(1 - window, 1)
                weights[full] = batch_weights(x[take], y[take], lag)
            for i in rows[np.isnan(weights[rows])]:
                weights[i] = granger_weight(x[tail(i)], y[tail(i)], lag)
        return pdf.assign(weight=weights).loc[~pdf[HALO], [*columns, "weight"]]

    blocks = spread(with_blocks(numbered, size, window + refresh), *order.keys, BLOCK)
    raw = blocks.groupBy(*order.keys, BLOCK).applyInPandas(block, schema)
    # The first weight is that of row `need`, and none is missing after it.
    known = raw.where(~F.isnan("weight")).withColumn("rn", F.col("rn") - (need - 1))
    return smooth_weights(known, order.keys, cause).withColumn("rn", F.col("rn") + (need - 1))


def smooth_weights(weights: DataFrame, keys: tuple[str, ...], cause: str = "cause", start: float = 0.5, size: int = 4096,
                   halo: int = 700) -> DataFrame:
    """Exponential average of numbered weights per edge from 0.5, at the speed of its column `cause`."""
    blocked = with_blocks(weights, size, halo)
    x = F.col("weight")

    def average(alpha: float) -> Column:
        return ema(F.when(F.col("rn") == 1, alpha * x + (1 - alpha) * start).otherwise(x), alpha, 1, keys, size, halo)

    smoothed = average(0.10)
    for alpha in sorted(set(EDGE_SPEED.values()) - {0.10}):
        names = [c for c, speed in EDGE_SPEED.items() if speed == alpha]
        smoothed = F.when(F.col(cause).isin(*names), average(alpha)).otherwise(smoothed)
    return own_rows(blocked.withColumn("smoothed", smoothed))
