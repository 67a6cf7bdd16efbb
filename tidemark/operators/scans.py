"""Sequential recursions per symbol.

Linear filters whose gains do not depend on the data are weighted running sums, so they stay window
expressions over blocks. Recursions that do depend on the data (variance with adapting parameters,
sticky regimes) run block by block in Arrow batches: all blocks at once from a guessed state, which a
warm-up stretch before the block gives. Then the state that each block ended in is handed on to the next,
and only spans of blocks from one whose incoming state changed by a bit run again, until none does (`speculative_scan`).
Sessions, which never forget within a day, are checked alike, and a key that fails is run in one ordered
pass, streamed in bounded memory (`carried_scan`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, d
from tidemark.operators.blocks import BLOCK, HALO, Order, block_window, index_rows, own_rows, spread, with_blocks

GAIN_ROWS, GAIN_HALO = 4096, 1024
SPAN = "_span"
#: Rows that one group runs through at most when blocks run again.
SPAN_ROWS = 65536


# --- linear filters ---------------------------------------------------------------------------

def kalman_gains(q: float, r: float, p0: float, floor: float = 0.0, ceiling: float = float("inf"),
                 eps: float = 0.0) -> list[float]:
    """Gains of a scalar random-walk filter until they no longer change; they do not depend on data."""
    p, gains = p0, []
    while True:
        pred = p + q
        k = pred / (pred + r + eps)
        p = min(max((1 - k) * pred, floor), ceiling)
        if gains and k == gains[-1] or len(gains) > 5000:
            return gains
        gains.append(k)


def gain_filter(x: Column, gains: list[float], start: float, keys: tuple[str, ...], size: int = GAIN_ROWS,
                halo: int = GAIN_HALO) -> Column:
    """s_t = s_{t-1} + K_t (x_t - s_{t-1}) from `start`, with the last gain repeated for ever.

    Written as sum of K_j x_j prod(1-K) between j and t; exponents are taken relative to mid-block.
    """
    n = F.col("rn")
    last = len(gains)
    decay, total = [], 0.0
    for g in gains:
        total += log(1.0 - g)
        decay.append(total)
    tail = log(1.0 - gains[-1])
    gain_of, decay_of = F.array(*[d(g) for g in gains]), F.array(*[d(v) for v in decay])

    def log_keep(pos: Column) -> Column:
        at = F.greatest(F.least(pos, F.lit(last)), F.lit(1)).cast("int")
        return F.element_at(decay_of, at) + F.greatest(pos - last, F.lit(0)) * d(tail)

    middle = log_keep(F.col(BLOCK) * size + (size - halo) // 2 + 1)
    gain = F.element_at(gain_of, F.least(n, F.lit(last)).cast("int"))
    term = gain * x + F.when(n == 1, d((1.0 - gains[0]) * start)).otherwise(d(0))
    run = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    own = log_keep(n)
    return F.sum(term * F.exp(middle - own)).over(run) * F.exp(own - middle)


def kalman_confidence(df: DataFrame, observation: str, order: Order, start: float = 0.55, size: int = GAIN_ROWS
                      ) -> DataFrame:
    """Smoothed confidence in [0.1, 0.99]."""
    gains = kalman_gains(0.001, 0.05, 0.1)
    out = with_blocks(index_rows(df.where(F.col(observation).isNotNull()), order), size, GAIN_HALO)
    state = gain_filter(F.col(observation), gains, start, order.keys, size)
    return own_rows(out.withColumn("confidence", clip(state, 0.1, 0.99)))


# Response speed per latent factor.
FACTOR_SPEED = {
    "momentum_short": 0.30,
    "market_microstructure": 0.28,
    "volatility_state": 0.25,
    "sentiment": 0.22,
    "mean_reversion": 0.20,
    "risk_regime": 0.15,
    "dollar_strength": 0.12,
    "yield_pressure": 0.10,
    "liquidity": 0.10,
    "inflation_pressure": 0.08,
    "macro_shock": 0.08,
    "positioning_bias": 0.07,
    "options_skew": 0.07,
    "momentum_long": 0.07,
    "geopolitical_risk": 0.05,
    "carry": 0.05,
}


def factor_gains(factor: str) -> list[float]:
    speed = FACTOR_SPEED.get(factor, 0.15)
    return kalman_gains(0.05 * speed, 0.5 - 0.3 * speed, 0.5, 1e-4, 2.0, 1e-8)


def kalman_factors(df: DataFrame, factors: dict[str, str], order: Order, size: int = GAIN_ROWS) -> DataFrame:
    """Filtered latent factors {factor: measurement column}; a missing measurement counts as zero."""
    out = with_blocks(index_rows(df, order), size, GAIN_HALO)
    return own_rows(out.withColumns({
        f"factor_{f}": gain_filter(F.coalesce(F.col(m), d(0)), factor_gains(f), 0.0, order.keys, size)
        for f, m in factors.items()}))


# --- data-dependent recursions ----------------------------------------------------------------

@dataclass(frozen=True)
class Scan:
    """A recursion over the ordered rows of a key.

    run(values, state) takes a float matrix [rows, inputs] and the state before the first row; it gives
    the output matrix [rows, outputs] and the state after the last row. prepare(values, rn) may add
    inputs that depend on a bounded number of earlier rows (`lookback`).
    """

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    start: tuple[float, ...]
    run: Callable[[np.ndarray, tuple[float, ...]], tuple[np.ndarray, tuple[float, ...]]]
    prepare: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    lookback: int = 0


def carried_scan(df: DataFrame, scan: Scan, order: Order, size: int = 16384, warmup: int = 2048) -> DataFrame:
    """Run a scan over numbered rows (`rn`), adding its outputs. Writes the block results once, to check them."""
    from tidemark.session import write_through

    keys = list(order.keys)
    rows = with_blocks(df, size, max(warmup, scan.lookback) + scan.lookback)
    fast = write_through(_run_blocks(rows.withColumn("_in", F.lit(None).cast("array<double>")), scan, keys, df.columns), "scan")
    ends = fast.where("_first OR _last").select(
        *keys, BLOCK, F.when(F.col("_first"), F.col("_before")).alias("s"), F.when(F.col("_last"), F.col("_after")).alias("e"))
    blocks = ends.groupBy(*keys, BLOCK).agg(F.max("s").alias("s"), F.max("e").alias("e"))
    w = Window.partitionBy(*keys).orderBy(BLOCK)  # one row per block
    met = F.lag("e").over(w)
    unmet = blocks.withColumn("_met", met).where(F.col("_met").isNotNull() & (F.col("_met") != F.col("s")))
    bad = unmet.select(*keys).distinct()
    result = fast.drop(BLOCK, "_first", "_last", "_before", "_after")
    if bad.isEmpty():
        return result
    again = _ordered_scan(df.join(bad, keys, "left_semi") if keys else df, scan, keys, result)
    kept = result.join(bad, keys, "left_anti") if keys else result.limit(0)
    return kept.unionByName(again)


def speculative_scan(df: DataFrame, scan: Scan, order: Order, size: int = 16384, warmup: int = 2048) -> DataFrame:
    """Run a scan over numbered rows (`rn`), adding its outputs; equal to one pass from the first row of a key.

    Round 0 runs every block from the state that a warm-up before it leads to. A table of one row per block holds the
    state before and after it; in each further round the blocks whose predecessor now ends in another state than they
    began with run again from that state, and so do those after them in a span of consecutive blocks, unless the state
    they began with is met. Spans are four times as long in each round, up to about SPAN_ROWS rows: a recursion that
    forgets a wrong guess after many blocks settles in a few rounds instead of one for each block, one that forgets
    within a block ends after one. Each round settles at least the first span that was not, so it ends. No task holds
    more than a span (or a block, if that is larger) and what it looks back on. Null keys are keys of their own.
    """
    from tidemark.session import write_through

    keys = list(order.keys)
    none = F.lit(None).cast("array<double>")
    rows = with_blocks(df, size, max(warmup, scan.lookback) + scan.lookback)
    rounds = [write_through(_run_blocks(rows.withColumn("_in", none), scan, keys, df.columns), "scan")]
    rows = with_blocks(rounds[0].select(*df.columns, "_first"), size, scan.lookback)  # a given state needs no warm-up
    states = write_through(_states_of(rounds[0], keys, 0), "states")
    before = Window.partitionBy(*keys).orderBy(BLOCK)  # one row per block
    while True:
        span = min(4 ** len(rounds), max(1, SPAN_ROWS // size))
        met = states.withColumn("_in", F.lag("_after").over(before)).withColumn(SPAN, F.floor(F.col(BLOCK) / span))
        changed = met.where(F.col("_in").isNotNull() & (F.col("_in") != F.col("_before")))
        if changed.isEmpty():
            break
        spans = changed.groupBy(*keys, SPAN).agg(F.min(BLOCK).alias("_from"), F.min_by("_in", BLOCK).alias("_in"))
        known = _joined(met.drop("_in"), spans, [*keys, SPAN], ["_from", "_in"], "inner").where(F.col(BLOCK) >= F.col("_from"))
        again = _joined(rows, known, [*keys, BLOCK], [SPAN, "_from", "_in", "_before", "_after"], "inner").where(
            (F.col(BLOCK) == F.col("_from")) | ~F.col(HALO))
        again = again.withColumns({c: F.when(F.col("_first"), F.col(c)) for c in ("_before", "_after")})
        rounds.append(write_through(_run_blocks(again, scan, keys, df.columns, SPAN), "scan"))
        new = _states_of(rounds[-1], keys, len(rounds) - 1)
        kept = _joined(states, new.select(*keys, BLOCK), [*keys, BLOCK], [], "left_anti")
        states = write_through(kept.unionByName(new), "states")
    last = states.select(*keys, BLOCK, "_round")
    results = rounds[0].withColumn("_at", F.lit(0))
    for n, part in enumerate(rounds[1:], 1):
        results = results.unionByName(part.withColumn("_at", F.lit(n)))
    if len(rounds) > 1:
        results = _joined(results, last, [*keys, BLOCK], ["_round"], "inner").where("_at = _round")
    return results.select(*df.columns, *scan.outputs)


def _joined(left: DataFrame, right: DataFrame, on: list[str], add: list[str], how: str) -> DataFrame:
    """`left` joined on columns that may be null, with the columns `add` of `right`."""
    other = right.select(*[F.col(c).alias(f"_of_{c}") for c in on], *add)
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = left.join(other, same, how)
    return out.drop(*[f"_of_{c}" for c in on]) if how == "inner" else out


def _states_of(results: DataFrame, keys: list[str], number: int) -> DataFrame:
    return results.where("_first OR _last").groupBy(*keys, BLOCK).agg(
        F.max("_before").alias("_before"), F.max("_after").alias("_after")).withColumn("_round", F.lit(number))


def _run_blocks(rows: DataFrame, scan: Scan, keys: list[str], columns: list[str], unit: str = BLOCK) -> DataFrame:
    """Each block of `rows` from its state `_in`, or from the start through its copied rows where that is null.

    With `unit` a span of blocks, `_in` belongs to its first block, and only that has copied rows; the next ones run on
    from it. Those that meet the state `_before` of their first row are left out, and their `_after` goes on.
    """
    state = "array<double>"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns]
    schema = ", ".join([*fields, f"{BLOCK} bigint", *[f"{o} double" for o in scan.outputs],
                        "_first boolean", "_last boolean", f"_before {state}", f"_after {state}"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable").reset_index(drop=True)
        rn = pdf["rn"].to_numpy()
        x = _prepared(_matrix(pdf, scan), rn, scan)
        n_halo = int(pdf[HALO].sum())  # copies precede the own rows
        given = pdf["_in"].iloc[0]
        if given is not None:
            state = tuple(float(v) for v in given)
        else:
            # Prepared inputs are complete only after the lookback; earlier copies serve them alone.
            skip, state = 0 if rn[0] == 1 else min(scan.lookback, n_halo), scan.start
            if n_halo > skip:
                _, state = scan.run(x[skip:n_halo], state)
        own = pdf.iloc[n_halo:]
        names = [*columns, BLOCK, *scan.outputs, "_first", "_last", "_before", "_after"]
        if own.empty:
            return pd.DataFrame(columns=names)
        out, x, of = own[[*columns, BLOCK]].copy(), x[n_halo:], own[BLOCK].to_numpy()
        m = len(out)
        known = list(zip(own["_before"], own["_after"])) if unit != BLOCK else [(None, None)] * m
        first = np.concatenate([[True], of[1:] != of[:-1]])
        begins = np.flatnonzero(first)
        before, after, ran = [None] * m, [None] * m, np.ones(m, dtype=bool)
        values = np.empty((m, len(scan.outputs)))
        for begin, end in zip(begins, [*begins[1:], m]):
            then, to = known[begin]
            if then is not None and list(then) == list(state):
                ran[begin:end], state = False, tuple(float(v) for v in to)
                continue
            before[begin] = list(state)
            values[begin:end], state = scan.run(x[begin:end], state)
            after[end - 1] = list(state)
        for i, name in enumerate(scan.outputs):
            out[name] = values[:, i]
        out["_first"], out["_last"] = first, np.concatenate([first[1:], [True]])
        out["_before"], out["_after"] = before, after
        return out[ran]

    return spread(rows, *keys, unit).groupBy(*keys, unit).applyInPandas(block, schema)


def _matrix(pdf: pd.DataFrame, scan: Scan) -> np.ndarray:
    return pdf[list(scan.inputs)].to_numpy(dtype=np.float64)


def _prepared(x: np.ndarray, rn: np.ndarray, scan: Scan) -> np.ndarray:
    return scan.prepare(x, rn) if scan.prepare else x


def _ordered_scan(df: DataFrame, scan: Scan, keys: list[str], like: DataFrame) -> DataFrame:
    """One pass over sorted rows, carrying the state of the current key from batch to batch."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys, "rn") if keys else df.coalesce(1).sortWithinPartitions("rn")
    columns = like.columns

    def stream(frames):
        current, state, tail = None, scan.start, None
        for pdf in frames:
            parts = pdf.groupby(keys, sort=False) if keys else [(None, pdf)]
            for key, part in parts:
                if key != current or current is None and keys:
                    current, state, tail = key, scan.start, None
                seen = part if tail is None else pd.concat([tail, part])
                x = _prepared(_matrix(seen, scan), seen["rn"].to_numpy(), scan)[len(seen) - len(part):]
                values, state = scan.run(x, state)
                tail = seen.tail(scan.lookback) if scan.lookback else None
                out = part.copy()
                for i, name in enumerate(scan.outputs):
                    out[name] = values[:, i]
                yield out[columns]

    return rows.mapInPandas(stream, like.schema)


def garch_scan(r: str = "log_ret", omega: float = 1e-8, alpha: float = 0.08, beta: float = 0.90, rate: float = 5e-4
               ) -> Scan:
    """Conditional variance w + a r^2 + b s^2 whose parameters follow the likelihood gradient, within bounds.

    Rows without a return keep the state.
    """
    def run(x: np.ndarray, state):
        w, a, b, s2, r2 = state
        out = np.empty((len(x), 4))
        for i, ret in enumerate(x[:, 0].tolist()):
            if ret == ret:
                pred = max(w + a * r2 + b * s2, 1e-12)
                sq = ret * ret
                g = rate * 0.5 * (1.0 / pred - sq / (pred * pred))
                w = min(max(w - g, 1e-12), 1e-2)
                a, b = min(max(a - g * r2, 0.001), 0.30), min(max(b - g * s2, 0.50), 0.998)
                if a + b >= 0.999:
                    shrink = 0.999 / (a + b)
                    a, b = a * shrink, b * shrink
                s2, r2 = pred, sq
            out[i] = (max(s2, 1e-12) ** 0.5, w, a, b)
        return out, (w, a, b, s2, r2)

    return Scan((r,), ("sigma", "omega", "alpha", "beta"), (omega, alpha, beta, 1e-6, 0.0), run)


REGIMES = ("RISK-ON", "RISK-OFF", "TRENDING", "RANGING")
REGIME_INPUTS = ("risk_regime", "volatility_state", "momentum_short", "momentum_long", "liquidity", "mean_reversion")
# Fixed values: (input, quantile, value while fewer than 30 rows are known).
REGIME_LEVELS = (("risk_regime", 0.65, 0.65), ("risk_regime", 0.35, 0.35), ("volatility_state", 0.70, 0.70),
                 ("volatility_state", 0.40, 0.40), ("momentum_short", 0.65, 0.60), ("momentum_long", 0.55, 0.55),
                 ("liquidity", 0.50, 0.50), ("mean_reversion", 0.60, 0.60))


def rolling_quantiles(x: np.ndarray, window: int, levels, least: int) -> np.ndarray:
    """[rows, levels] quantiles of the last `window` values of the chosen inputs; default while cold."""
    out = np.empty((len(x), len(levels)))
    for j, (name, q, default) in enumerate(levels):
        values = pd.Series(x[:, REGIME_INPUTS.index(name)])
        rolled = values.rolling(window, min_periods=1)
        out[:, j] = rolled.quantile(q)
        out[rolled.count().to_numpy() < least, j] = default
    return out


def regime_scan(window: int = 500, sticky: float = 0.6, bonus: float = 0.05) -> Scan:
    """Sticky regime: scores against rolling-quantile levels, blended with their past, largest wins.

    Inputs are the six factors; a null scores 0.5 and stays out of the levels, which are the defaults until a
    factor has 30 known values in the window.
    """
    def prepare(x: np.ndarray, rn: np.ndarray) -> np.ndarray:
        return np.hstack([np.where(np.isnan(x), 0.5, x), rolling_quantiles(x, window, REGIME_LEVELS, 30)])

    def run(x: np.ndarray, state):
        risk, vol, mom, slow, liq, rev, rhi, rlo, vhi, vlo, mhi, shi, lhi, qhi = x.T
        raw = np.column_stack([
            np.maximum(0.0, (risk - rhi) + (vlo - vol) + (liq - lhi)), np.maximum(0.0, (rlo - risk) + (vol - vhi)),
            np.maximum(0.0, (mom - mhi) + (slow - shi)), np.maximum(0.0, (rev - qhi) + 0.1)])
        score, current = list(state[:4]), int(state[4])
        scores, codes = [], []
        for now in ((1.0 - sticky) * raw).tolist():
            score = [a + sticky * b for a, b in zip(now, score)]
            score[current] += bonus
            current = score.index(max(score))
            scores.append(score)
            codes.append(current)
        s = np.array(scores).reshape(-1, 4)
        share = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)  # softmax of the largest
        return np.column_stack([np.array(codes, dtype=float), share]), (*score, float(current))

    return Scan(REGIME_INPUTS, ("regime_code", "regime_confidence"), (0.25, 0.25, 0.25, 0.25, 3.0), run, prepare,
                window - 1)


def with_regime(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(r) for r in REGIMES])
    return df.withColumn("regime", F.get(names, F.col("regime_code").cast("int"))).drop("regime_code")


def regime_of_levels() -> Column:
    """Stateless rule with fixed levels; the first that applies wins."""
    c = F.col
    return (F.when((c("risk_regime") > 0.65) & (c("volatility_state") < 0.4) & (c("liquidity") > 0.5), "RISK-ON")
            .when((c("risk_regime") < 0.35) | (c("volatility_state") > 0.7), "RISK-OFF")
            .when((c("momentum_short") > 0.6) & (c("momentum_long") > 0.55), "TRENDING").otherwise("RANGING"))


def session_scan(session_seconds: float = 24 * 3600) -> Scan:
    """Volume-weighted price of sessions that restart at the first tick more than a day after their start."""
    def run(x: np.ndarray, state):
        start, pv, vv = state
        out = np.empty((len(x), 2))
        for i, (t, price, volume) in enumerate(x.tolist()):
            if start < 0 or t - start > session_seconds:
                start, pv, vv = t, 0.0, 0.0
            weight = volume if volume > 0 else 1.0
            pv, vv = pv + price * weight, vv + weight
            vwap = pv / max(vv, 1e-10)
            out[i] = (vwap, min(max((price - vwap) / (vwap + 1e-8), -1.0), 1.0))
        return out, (start, pv, vv)

    return Scan(("seconds", "mid", "volume"), ("vwap", "vwap_dev"), (-1.0, 0.0, 0.0), run)


# --- feature rows -----------------------------------------------------------------------------

def lagged_return_row(df: DataFrame, order: Order, lags: int = 60, states: tuple[str, ...] = (), sigma: str | None = None,
                      bound: float = 0.05, size: int = 16384) -> DataFrame:
    """Array of the last clipped log returns (zeros in front while short), state values and volatility.

    Expects numbered rows with `log_ret`.
    """
    w = block_window(order.keys).rowsBetween(-(lags - 1), 0)
    out = own_rows(with_blocks(df, size, lags).withColumn("_r", F.collect_list("log_ret").over(w)))
    clipped = F.transform("_r", lambda v: F.greatest(F.least(v, d(bound)), d(-bound)))
    parts = [F.array_repeat(d(0), F.lit(lags) - F.size("_r")), clipped]
    extra = [F.coalesce(F.col(c).cast("double"), d(0)) for c in (*states, *([sigma] if sigma else []))]
    if extra:
        parts.append(F.array(*extra))
    return out.withColumn("features", F.concat(*parts)).drop("_r")


def modality_errors(df: DataFrame, signals: dict[str, str], error: str) -> DataFrame:
    """Settled errors attributed to each modality: |error| times its signal, one row per modality."""
    entries = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(c).cast("double").alias("signal"))
                        for m, c in signals.items()])
    keep = [c for c in df.columns if c not in signals.values()]
    out = df.where(F.col(error).isNotNull()).select(*keep, F.explode(entries).alias("_m"))
    return out.select(*keep, "_m.modality", (F.abs(F.col(error)) * F.col("_m.signal")).alias("attributed_error"))
