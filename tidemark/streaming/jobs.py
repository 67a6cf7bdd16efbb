"""Streaming transformations: normalise, candles, de-duplication, and state per key.

Rows of a micro-batch are ordered by event time and id before they meet the state. The trigger options
of the source (maxFilesPerTrigger, maxOffsetsPerTrigger) bound how much of a busy symbol one batch holds;
the state of a symbol is a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.functions.numeric import MAD_SIGMA
from tidemark.operators import bars, normalize
from tidemark.operators.scans import garch_scan


def normalise(raw: DataFrame) -> dict[str, DataFrame]:
    """Typed streams of good events and a stream of rejected ones."""
    return normalize.route(raw)


def candle_stream(ticks: DataFrame, duration: str = "60 seconds", lateness: str = "1 minute",
                  keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Candles emitted once their window is past the watermark; later ticks are dropped."""
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return bars.candles(timed, duration, keys, ts)


def dedup_stream(events: DataFrame, key: str | list[str], ts: str = "ts", within: str = "1 day") -> DataFrame:
    """First arrival per key; a key is forgotten once the watermark has passed it by `within`."""
    keys = [key] if isinstance(key, str) else list(key)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable").reset_index(drop=True)


def changed_values(obs: DataFrame, key: str = "series_id", at: str = "date", value: str = "value") -> DataFrame:
    """Emit an observation only if its value differs from the last one emitted for the series."""
    fields = {f.name: f.dataType.simpleString() for f in obs.schema}
    schema = f"{key} {fields[key]}, {at} {fields[at]}, {value} double"

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        rows = []
        for r in _ordered(frames, [at]).itertuples(index=False):
            v = getattr(r, value)
            if v is None or v != v or v == last:
                continue
            last = float(v)
            rows.append((k[0], getattr(r, at), last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=[key, at, value])

    return obs.groupBy(key).applyInPandasWithState(step, schema, "last double", "append",
                                                    GroupStateTimeout.NoTimeout)


#: Rows of a result that a step gathers before it passes them on.
CHUNK = 8192
INDICATORS = ("macd", "macd_signal", "z_price", "sigma", "confidence", "vwap_dev")
_STATE = ("n bigint, prev double, fast double, slow double, signal double, mu double, var double, "
          "garch array<double>, conf double, cov double, start double, pv double, vv double, window array<double>")


def symbol_state(ticks: DataFrame, window: int = 200, alpha: float = 0.02, session_seconds: float = 86400.0) -> DataFrame:
    """Running indicators per symbol: MACD, rolling robust z, conditional volatility, smoothed confidence of the
    volume share and the session price deviation. Columns: symbol, ts (seconds), event_id, mid, volume, obs."""
    garch = garch_scan("r")
    q, r_noise = 0.001, 0.05

    def step(k, frames, state):
        pdf = _ordered(frames, ["ts", "event_id"])
        pdf = pdf[pdf["mid"] > 0]
        if state.exists:
            n, prev, fast, slow, sig, mu, var, g, conf, cov, start, pv, vv, buf = state.get
            g, buf = tuple(g), list(buf)
        else:
            n, prev, fast, slow, sig, mu, var = 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0
            g, conf, cov, start, pv, vv, buf = garch.start, 0.55, 0.1, -1.0, 0.0, 0.0, []
        out = []
        for t in pdf.itertuples(index=False):
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=["symbol", "event_id", *INDICATORS])
                out = []
            n += 1
            p, volume = float(t.mid), float(t.volume)
            if n == 1:
                mu, var = p, 1.0
            else:
                dev = p - mu
                mu, var = mu + alpha * dev, (1 - alpha) * (var + alpha * dev * dev)
                _, g = garch.run(np.array([[np.log(p / prev)]]), g)
                if n == 2:
                    fast = slow = p
                    sig = 0.0
                else:
                    fast, slow = fast + 2 / 13 * (p - fast), slow + 2 / 27 * (p - slow)
                    sig = 0.8 * sig + 0.2 * (fast - slow)
            buf = (buf + [p])[-window:]
            if n >= 30:
                a = np.asarray(buf)
                med = float(np.median(a))
                mad = float(np.median(np.abs(a - med)))
                z = (p - med) / ((MAD_SIGMA * mad if mad > 1e-12 else var ** 0.5) + 1e-12)
            else:
                z = (p - mu) / (var ** 0.5 + 1e-12)
            gain = (cov + q) / (cov + q + r_noise)
            conf, cov = conf + gain * (float(t.obs) - conf), (1 - gain) * (cov + q)
            if start < 0 or t.ts - start > session_seconds:
                start, pv, vv = float(t.ts), 0.0, 0.0
            weight = volume if volume > 0 else 1.0
            pv, vv = pv + p * weight, vv + weight
            vwap = pv / max(vv, 1e-10)
            prev = p
            if n >= 2:
                out.append((k[0], int(t.event_id), (fast - slow) / (p + 1e-8), sig / (p + 1e-8), float(np.clip(z, -8, 8)),
                            max(g[3], 1e-12) ** 0.5, float(np.clip(conf, 0.1, 0.99)),
                            float(np.clip((p - vwap) / (vwap + 1e-8), -1, 1))))
        state.update((n, prev, fast, slow, sig, mu, var, list(g), conf, cov, start, pv, vv, buf))
        yield pd.DataFrame(out, columns=["symbol", "event_id", *INDICATORS])

    schema = "symbol string, event_id bigint, " + ", ".join(f"{c} double" for c in INDICATORS)
    rows = ticks.select("symbol", "ts", "event_id", "mid", "volume", "obs")
    return rows.groupBy("symbol").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def delayed_settlement(ticks: DataFrame, horizons: tuple[int, ...] = (5, 30)) -> DataFrame:
    """For each tick, once h more have come: its realised log return and error against `pred`.

    Columns: symbol, ts, event_id, mid, pred. The state is the last max(h) ticks of the symbol.
    """
    longest = max(horizons)

    def step(k, frames, state):
        ids, mids, preds = ([list(v) for v in state.get] if state.exists else ([], [], []))
        out = []
        for t in _ordered(frames, ["ts", "event_id"]).itertuples(index=False):
            if not t.mid > 0:
                continue
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=["symbol", "event_id", "horizon", "realised", "abs_error"])
                out = []
            for h in horizons:
                if len(ids) >= h:
                    real = float(np.log(t.mid / mids[-h]))
                    out.append((k[0], ids[-h], h, real, abs(real - preds[-h])))
            ids, mids, preds = ((a + [b])[-longest:] for a, b in
                                ((ids, int(t.event_id)), (mids, float(t.mid)), (preds, float(t.pred))))
        state.update((ids, mids, preds))
        yield pd.DataFrame(out, columns=["symbol", "event_id", "horizon", "realised", "abs_error"])

    return ticks.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, event_id bigint, horizon int, realised double, abs_error double",
        "ids array<bigint>, mids array<double>, preds array<double>", "append", GroupStateTimeout.NoTimeout)


def fusion_rows(ticks: DataFrame, feeds: dict[str, DataFrame], symbols: list[str] | None = None) -> DataFrame:
    """One stream of ticks and feed rows: symbol, ts (seconds), kind, event_id, value.

    Feeds without a symbol are meant for all of the listed symbols.
    """
    out = ticks.select("symbol", "ts", F.lit("tick").alias("kind"), "event_id", F.col("mid").alias("value"))
    for name, feed in feeds.items():
        if "symbol" not in feed.columns:
            feed = feed.withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in symbols or []])))
        out = out.unionByName(feed.select("symbol", "ts", F.lit(name).alias("kind"), F.lit(-1).cast("long").alias("event_id"),
                                          F.col("value").cast("double").alias("value")))
    return out


def latest_value_stream(rows: DataFrame, feeds: list[str]) -> DataFrame:
    """Each tick with the newest value of every feed (null before the first)."""
    def step(k, frames, state):
        latest = list(state.get[0]) if state.exists else [None] * len(feeds)
        out = []
        for r in _ordered(frames, ["ts", "event_id"]).itertuples(index=False):
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=["symbol", "event_id", "mid", *feeds])
                out = []
            if r.kind == "tick":
                out.append((k[0], int(r.event_id), float(r.value), *latest))
            else:
                latest[feeds.index(r.kind)] = float(r.value)
        state.update((latest,))
        yield pd.DataFrame(out, columns=["symbol", "event_id", "mid", *feeds])

    schema = "symbol string, event_id bigint, mid double, " + ", ".join(f"{f} double" for f in feeds)
    return rows.groupBy("symbol").applyInPandasWithState(step, schema, "latest array<double>", "append",
                                                         GroupStateTimeout.NoTimeout)


