"""Tick-level technical indicators.

Input: one row per tick with symbol, ts, event_id (unique within a timestamp), mid, spread, volume.
All windows count valid ticks of one symbol and include the current one. Results start at the second
tick, as there is no return before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import MAD_SIGMA, clip, d
from tidemark.operators.blocks import (
    BLOCK, HALO, Order, block_window, index_rows, own_rows, ticks_order, trailing, with_blocks)
from tidemark.operators.rolling import map_blocks, rolling_median_mad

# Rows per block. An exponential average is a running sum of geometrically weighted values, and the
# weights over one block must stay inside the double range for the fastest average (period 9).
BLOCK_ROWS = 4096
# Rows copied in front of a block: the 26-period average forgets to below 1e-17 in 500 rows,
# the 9-period average of it in another 180; the longest plain window is 201.
HALO_ROWS = 768

ZBLOCK_ROWS, ZHALO_ROWS = 16384, 2048  # for the slow average (alpha 0.02) of the rolling scaler


def valid_ticks(df: DataFrame) -> DataFrame:
    """Keep ticks with a positive price; others leave no trace in any window."""
    return df.where(F.col("mid") > 0)


def numbered_ticks(df: DataFrame, order: Order | None = None) -> DataFrame:
    """Valid ticks with their number within the symbol; a frame that has `rn` is taken as it is."""
    if "rn" in df.columns:
        return df
    return index_rows(valid_ticks(df), order or ticks_order())


def blocked_ticks(df: DataFrame, order: Order | None = None, size: int = BLOCK_ROWS,
                  halo: int = HALO_ROWS) -> DataFrame:
    return with_blocks(numbered_ticks(df, order), size, halo)


def ema(x: Column, alpha: float, first: int, keys: tuple[str, ...], size: int, halo: int) -> Column:
    """Recursive exponential average seeded with the value at row `first`, inside a block.

    e_t = (1-a) e_{t-1} + a x_t is (1-a)^t times a running sum of a x_j (1-a)^-j. Exponents are
    counted from the middle of the block. Rows before the copied head weigh less than one rounding.
    """
    keep = 1.0 - alpha
    pos = F.col("rn") - F.col(BLOCK) * size - F.lit((size - halo) // 2)
    scale = F.pow(d(keep), -pos)
    weight = F.when(F.col("rn") == first, d(1.0)).when(F.col("rn") > first, d(alpha)).otherwise(d(0.0))
    run = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(x * weight * scale).over(run) * F.pow(d(keep), pos)


def frac_diff_weights(order: float = 0.4, size: int = 60, tol: float = 1e-5) -> list[float]:
    """Binomial weights of (1-L)^order, newest first."""
    weights = [1.0]
    while len(weights) < size:
        k = len(weights)
        nxt = weights[-1] * (k - 1 - order) / k
        if abs(nxt) < tol:
            break
        weights.append(nxt)
    return weights


def tick_indicators(df: DataFrame, order: Order | None = None, size: int = BLOCK_ROWS,
                    halo: int = HALO_ROWS) -> DataFrame:
    """All bounded-window indicators. Select what you need: Catalyst drops the other windows."""
    order = order or ticks_order()
    keys = order.keys
    w = block_window(keys)
    p, n = F.col("mid"), F.col("rn")
    scale = F.greatest(p, d(1e-8))

    def lag(k: int) -> Column:
        return F.lag(p, k).over(w)

    out = with_blocks(numbered_ticks(df, order), size, halo)
    out = out.withColumns({
        "_prev": lag(1),
        "_half": F.greatest(F.col("spread") * 0.5, p * 1e-6),
    }).withColumns({
        "_high": p + F.col("_half"),
        "_low": p - F.col("_half"),
        "_delta": p - F.col("_prev"),
        "_obv_step": F.when((n > 1) & (F.col("volume") > 0),
                            F.when(p >= F.col("_prev"), F.col("volume")).otherwise(-F.col("volume")))
        .otherwise(d(0)),
        "_fast": ema(p, 2 / 13, 2, keys, size, halo),
        "_slow": ema(p, 2 / 27, 2, keys, size, halo),
        "_obv": d(0),
    })

    def ret(k: int) -> Column:
        return F.when(n > k, (p - lag(k)) / lag(k)).otherwise(d(0))

    def vol(k: int) -> Column:
        return F.when(n >= k, F.stddev_pop(p).over(trailing(w, k)) / scale).otherwise(d(0))

    def momentum(k: int) -> Column:
        return F.when(n > k, (p - lag(k - 1)) / scale).otherwise(d(0))

    gains = F.avg(F.greatest(F.col("_delta"), d(0))).over(trailing(w, 14))
    losses = F.avg(F.greatest(-F.col("_delta"), d(0))).over(trailing(w, 14))
    w14, w20 = trailing(w, 14), trailing(w, 20)
    mean20, sd20 = F.avg(p).over(w20), F.stddev_pop(p).over(w20) + 1e-8
    weights = frac_diff_weights()
    frac = sum((d(c) * lag(k) for k, c in enumerate(weights) if k), d(weights[0]) * p)
    money = (2 * p - F.col("_high") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-8)
    vol14 = F.sum("volume").over(w14)
    obv_run = w.rowsBetween(Window.unboundedPreceding, 0)

    out = out.withColumns({
        # The level of on-balance volume cancels in its own range, so a sum from the block head does.
        "_obv": F.sum("_obv_step").over(obv_run),
        "_hi14": F.max("_high").over(w14),
        "_lo14": F.min("_low").over(w14),
        "_macd": F.col("_fast") - F.col("_slow"),
        "_gain": gains,
        "_loss": losses,
    }).withColumns({
        "_rng14": F.col("_hi14") - F.col("_lo14"),
        "_signal": ema(F.col("_macd"), 0.2, 2, keys, size, halo),
        "_obv_lo": F.min("_obv").over(trailing(w, 200)),
        "_obv_hi": F.max("_obv").over(trailing(w, 200)),
    })
    rng = F.col("_rng14")
    stoch = F.when((n >= 14) & (rng > 1e-8), clip((p - F.col("_lo14")) / rng, 0, 1)).otherwise(d(0.5))
    will = F.when((n >= 14) & (rng > 1e-8), 1 - clip((F.col("_hi14") - p) / rng, 0, 1)).otherwise(d(0.5))
    obv_rng = F.col("_obv_hi") - F.col("_obv_lo")
    out = out.withColumns({
        "returns_1": ret(1), "returns_5": ret(5), "returns_20": ret(20),
        "vol_5": vol(5), "vol_20": vol(20),
        "momentum_5": momentum(5), "momentum_20": momentum(20),
        "rsi_14": F.when(n < 15, d(50)).when(F.col("_loss") < 1e-12, d(100))
        .otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss"))),
        "atr_14": F.avg(F.abs("_delta")).over(w14) / scale,
        "bb_pct": F.when(n >= 20, clip((p - (mean20 - 2 * sd20)) / (4 * sd20), 0, 1)).otherwise(d(0.5)),
        "stoch_k": stoch,
        "williams_r": will,
        "cmf": F.when((n >= 14) & (vol14 > 1e-8),
                      clip(F.sum(money * F.col("volume")).over(w14) / vol14, -1, 1)).otherwise(d(0)),
        "obv_norm": F.when((n >= 20) & (obv_rng > 1e-8),
                           clip(2 * (F.col("_obv") - F.col("_obv_lo")) / obv_rng - 1, -1, 1)).otherwise(d(0)),
        "macd": F.col("_macd") / (p + 1e-8),
        "macd_signal": F.col("_signal") / (p + 1e-8),
        # The differencing buffer starts at the second tick.
        "frac_diff": F.when(n > len(weights), frac).otherwise(d(0)),
        "spread_pct": F.col("spread") / (p + 1e-8),
        "high": F.col("_high"), "low": F.col("_low"),
    }).withColumn(
        "stoch_d", F.when(n >= 14, F.avg("stoch_k").over(trailing(w, 3))).otherwise(d(0.5)))
    internal = [c for c in out.columns if c.startswith("_") and c not in (BLOCK, HALO)]
    return own_rows(out.drop(*internal)).where(F.col("rn") >= 2)


def session_vwap(df: DataFrame, grain_seconds: int = 60) -> DataFrame:
    """Deviation from the volume-weighted average price of the calendar day so far."""
    from tidemark.operators.blocks import running

    base = valid_ticks(df).withColumn("session", F.to_date("ts"))
    weight = F.when(F.col("volume") > 0, F.col("volume")).otherwise(d(1))
    order = ticks_order(("symbol", "session"), grain_seconds=grain_seconds)
    out = running(base, order, {"_pv": ("sum", F.col("mid") * weight), "_vv": ("sum", weight)})
    vwap = F.col("_pv") / F.greatest(F.col("_vv"), d(1e-10))
    return (out.withColumn("vwap", vwap)
            .withColumn("vwap_dev", clip((F.col("mid") - F.col("vwap")) / (F.col("vwap") + 1e-8), -1, 1))
            .drop("_pv", "_vv"))


def cumulative_moments(df: DataFrame, value: str, order: Order) -> DataFrame:
    """Count, mean and sample deviation of `value` over all rows of the key so far."""
    from tidemark.operators.blocks import running

    # Sums of distances from the key's mean: squares of the values themselves cancel where their level is high.
    level = df.groupBy(*order.keys).agg(F.coalesce(F.avg(value), d(0)).alias("_level"))
    level = level.select(*[F.col(k).alias(f"_of_{k}") for k in order.keys], "_level")
    same = F.lit(True)
    for k in order.keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    x = F.col(value) - F.col("_level")
    out = running(df.join(level, same), order, {"cum_n": ("count", x), "_s1": ("sum", x), "_s2": ("sum", x * x)})
    n = F.col("cum_n")
    var = (F.col("_s2") - F.col("_s1") * F.col("_s1") / n) / (n - 1)
    return (out.withColumn("cum_mean", F.when(n > 0, F.col("_level") + F.col("_s1") / n))
            .withColumn("cum_sd", F.when(n > 1, F.sqrt(F.greatest(var, d(0)))))
            .drop("_s1", "_s2", "_level", *[f"_of_{k}" for k in order.keys]))


def log_returns(df: DataFrame, order: Order | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """Numbered ticks with the log return to the previous tick (null at the first)."""
    order = order or ticks_order()
    w = block_window(order.keys)
    out = with_blocks(numbered_ticks(df, order), size, 1)
    return own_rows(out.withColumn("log_ret", F.log(F.col("mid") / F.lag("mid").over(w))))


def z_price_fallback(df: DataFrame, order: Order | None = None, z: str | None = None) -> DataFrame:
    """Where the incoming z is zero, standardise the latest log return by all returns so far."""
    order = order or ticks_order()
    given = F.coalesce(F.col(z), d(0)) if z else d(0)
    out = cumulative_moments(log_returns(df, order), "log_ret", order)
    fallback = (F.col("log_ret") - F.col("cum_mean")) / F.col("cum_sd")
    use = (F.abs(given) < 1e-12) & (F.col("cum_n") > 5) & (F.col("cum_sd") > 1e-10)
    return (out.withColumn("z_price", clip(F.when(use, fallback).otherwise(given), -10, 10))
            .where(F.col("rn") >= 2))


def rolling_robust_z(df: DataFrame, value: str = "mid", order: Order | None = None, window: int = 200,
                     alpha: float = 0.02, size: int = ZBLOCK_ROWS, halo: int = ZHALO_ROWS) -> DataFrame:
    """Rolling median/MAD z-score with an exponential-average fallback while cold or flat.

    Adds z_price, price_mean (rolling median) and price_std (MAD sigma).
    """
    order = order or ticks_order()
    numbered = numbered_ticks(df, order)

    def block(x: np.ndarray, rn: np.ndarray) -> dict[str, np.ndarray]:
        keep = 1.0 - alpha
        mu = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        dev = np.diff(x, prepend=x[0])
        dev[1:] = x[1:] - mu[:-1]
        # var_t = (1-a) var_{t-1} + a (1-a) dev_t^2 with var_1 = 1
        steps = keep * dev * dev
        steps[0] = 1.0
        ewma_sd = np.sqrt(pd.Series(steps).ewm(alpha=alpha, adjust=False).mean().to_numpy())
        med, mad = rolling_median_mad(x, window)
        sigma = np.where(mad > 1e-12, MAD_SIGMA * mad, ewma_sd)
        z = np.where(rn >= 30, (x - med) / (sigma + 1e-12), (x - mu) / (ewma_sd + 1e-12))
        return {"z_price": np.clip(z, -8, 8), "price_mean": med, "price_std": np.where(rn < 2, 1.0, sigma)}

    return map_blocks(numbered, order.keys, value, block, ("z_price", "price_mean", "price_std"), size, halo)


VECTOR = ("z_price", "returns_1", "returns_5", "returns_20", "vol_5", "vol_20", "rsi_14", "atr_14", "vwap_dev",
          "spread_pct", "momentum_5", "momentum_20", "frac_diff", "macd", "macd_signal", "bb_pct", "stoch_k", "stoch_d",
          "williams_r", "obv_norm", "cmf")


def market_vector() -> Column:
    """The 21 scale-free entries of a tick in fixed order; bounded indicators are centred on zero."""
    def entry(name: str) -> Column:
        if name == "rsi_14":
            return (F.col(name) - 50.0) / 50.0
        if name in ("bb_pct", "stoch_k", "stoch_d", "williams_r"):
            return F.col(name) * 2 - 1.0
        return F.col(name)

    return F.array(*[entry(name) for name in VECTOR])


def tick_features(df: DataFrame, order: Order | None = None) -> DataFrame:
    """All indicators of a tick with its rolling z, session price deviation and feature vector."""
    # Each step keeps the columns before it, and the numbering of the second serves the third.
    out = tick_indicators(rolling_robust_z(session_vwap(df), order=order), order)
    return out.withColumn("vector", market_vector())


def modality_error_average(df: DataFrame, error: str, alpha: float = 0.08, start: float = 0.1,
                           keys: tuple[str, ...] = ("modality",), order: Order | None = None,
                           size: int = ZBLOCK_ROWS, halo: int = 512) -> DataFrame:
    """Exponential average of bounded absolute errors from a fixed start value, per key."""
    order = order or ticks_order(keys)
    e = F.least(F.abs(F.col(error)), d(5))
    out = with_blocks(index_rows(df.where(F.col(error).isNotNull()), order), size, halo)
    n, keep = F.col("rn"), 1 - alpha
    first = alpha * e + keep * start
    x = F.when(n == 1, first).otherwise(e)
    return own_rows(out.withColumn("err_avg", ema(x, alpha, 1, order.keys, size, halo)))


def attention_weights(errors: dict[str, Column], temperature: float = 2.0) -> dict[str, Column]:
    """Softmax of minus log error over the modalities."""
    from tidemark.functions.numeric import softmax

    return softmax({m: -F.log(e + 1e-3) / temperature for m, e in errors.items()})
