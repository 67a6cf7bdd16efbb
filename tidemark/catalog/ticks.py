"""Tick queries: indicators, candles, clock, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views
from tidemark.operators import ticks as T

NUMBERED = """
n AS (SELECT *, row_number() OVER s AS rn, lag(mid) OVER s AS prev FROM ticks
      WINDOW s AS (PARTITION BY symbol ORDER BY ts, event_id))"""


def indicator_query(name: str, digits: dict[str, int], body: str, recursive: bool = False) -> None:
    sql = with_views(
        ["ticks"], f"{NUMBERED}{body}\nSELECT event_id, symbol, {rounded_sql(digits)} FROM r WHERE rn >= 2", recursive)

    @query(name, sql)
    def run(spark, sf_dir):
        out = T.tick_indicators(views.ticks(spark, sf_dir))
        return rounded(out.select("event_id", "symbol", *digits), digits)


W = "PARTITION BY symbol ORDER BY rn"

indicator_query("tick_returns_vol", {"returns_1": 6, "returns_5": 6, "returns_20": 6, "vol_5": 6, "vol_20": 6,
                                     "atr_14": 6, "bb_pct": 6, "spread_pct": 6}, f""",
r AS (SELECT event_id, symbol, rn,
  CASE WHEN rn > 1 THEN (mid - lag(mid, 1) OVER w) / lag(mid, 1) OVER w ELSE 0e0 END AS returns_1,
  CASE WHEN rn > 5 THEN (mid - lag(mid, 5) OVER w) / lag(mid, 5) OVER w ELSE 0e0 END AS returns_5,
  CASE WHEN rn > 20 THEN (mid - lag(mid, 20) OVER w) / lag(mid, 20) OVER w ELSE 0e0 END AS returns_20,
  CASE WHEN rn >= 5 THEN stddev_pop(mid) OVER (w ROWS 4 PRECEDING) / mid ELSE 0e0 END AS vol_5,
  CASE WHEN rn >= 20 THEN stddev_pop(mid) OVER (w ROWS 19 PRECEDING) / mid ELSE 0e0 END AS vol_20,
  avg(abs(mid - prev)) OVER (w ROWS 13 PRECEDING) / mid AS atr_14,
  CASE WHEN rn >= 20 THEN greatest(0e0, least(1e0,
     (mid - (avg(mid) OVER (w ROWS 19 PRECEDING) - 2 * (stddev_pop(mid) OVER (w ROWS 19 PRECEDING) + 1e-8)))
      / (4 * (stddev_pop(mid) OVER (w ROWS 19 PRECEDING) + 1e-8)))) ELSE 0.5e0 END AS bb_pct,
  spread / (mid + 1e-8) AS spread_pct
  FROM n WINDOW w AS ({W}))""")

indicator_query("tick_oscillators", {"momentum_5": 6, "momentum_20": 6, "rsi_14": 6, "stoch_k": 6, "stoch_d": 6,
                                     "williams_r": 6, "high": 8, "low": 8, "cmf": 6}, f""",
h AS (SELECT *, mid + greatest(spread * 0.5e0, mid * 1e-6) AS high, mid - greatest(spread * 0.5e0, mid * 1e-6) AS low,
  avg(greatest(mid - prev, 0e0)) OVER (w ROWS 13 PRECEDING) AS g,
  avg(greatest(prev - mid, 0e0)) OVER (w ROWS 13 PRECEDING) AS l
  FROM n WINDOW w AS ({W})),
k AS (SELECT *, max(high) OVER (w ROWS 13 PRECEDING) AS hi, min(low) OVER (w ROWS 13 PRECEDING) AS lo
  FROM h WINDOW w AS ({W})),
o AS (SELECT *,
  CASE WHEN rn >= 14 AND hi - lo > 1e-8 THEN greatest(0e0, least(1e0, (mid - lo) / (hi - lo))) ELSE 0.5e0 END AS stoch_k
  FROM k),
r AS (SELECT event_id, symbol, rn, high, low, stoch_k,
  CASE WHEN rn > 5 THEN (mid - lag(mid, 4) OVER w) / mid ELSE 0e0 END AS momentum_5,
  CASE WHEN rn > 20 THEN (mid - lag(mid, 19) OVER w) / mid ELSE 0e0 END AS momentum_20,
  CASE WHEN rn < 15 THEN 50e0 WHEN l < 1e-12 THEN 100e0 ELSE 100e0 - 100e0 / (1 + g / l) END AS rsi_14,
  CASE WHEN rn >= 14 THEN avg(stoch_k) OVER (w ROWS 2 PRECEDING) ELSE 0.5e0 END AS stoch_d,
  CASE WHEN rn >= 14 AND hi - lo > 1e-8 THEN 1 - greatest(0e0, least(1e0, (hi - mid) / (hi - lo))) ELSE 0.5e0 END
    AS williams_r,
  CASE WHEN rn >= 14 AND sum(volume) OVER (w ROWS 13 PRECEDING) > 1e-8 THEN greatest(-1e0, least(1e0,
    sum((2 * mid - high - low) / (high - low + 1e-8) * volume) OVER (w ROWS 13 PRECEDING)
      / sum(volume) OVER (w ROWS 13 PRECEDING))) ELSE 0e0 END AS cmf
  FROM o WINDOW w AS ({W}))""")

indicator_query("tick_obv", {"obv_norm": 6}, f""",
b AS (SELECT *, sum(CASE WHEN rn > 1 AND volume > 0 THEN CASE WHEN mid >= prev THEN volume ELSE -volume END
                         ELSE 0e0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM n),
m AS (SELECT *, min(obv) OVER (w ROWS 199 PRECEDING) AS lo, max(obv) OVER (w ROWS 199 PRECEDING) AS hi
  FROM b WINDOW w AS ({W})),
r AS (SELECT event_id, symbol, rn, CASE WHEN rn >= 20 AND hi - lo > 1e-8
  THEN greatest(-1e0, least(1e0, 2 * (obv - lo) / (hi - lo) - 1)) ELSE 0e0 END AS obv_norm FROM m)""")

indicator_query("tick_macd", {"macd": 6, "macd_signal": 6}, f""",
l AS (SELECT symbol, list(mid ORDER BY rn) AS x, list(event_id ORDER BY rn) AS ids FROM n WHERE rn >= 2 GROUP BY symbol),
step(symbol, i, fast, slow, sig) AS (
  SELECT symbol, 1, x[1], x[1], 0e0 FROM l
  UNION ALL
  SELECT s.symbol, s.i + 1, s.fast * (11e0 / 13e0) + l.x[s.i + 1] * (2e0 / 13e0),
         s.slow * (25e0 / 27e0) + l.x[s.i + 1] * (2e0 / 27e0),
         s.sig * 0.8e0 + 0.2e0 * ((s.fast * (11e0 / 13e0) + l.x[s.i + 1] * (2e0 / 13e0))
                                  - (s.slow * (25e0 / 27e0) + l.x[s.i + 1] * (2e0 / 27e0)))
  FROM step s JOIN l USING (symbol) WHERE s.i < len(l.x)),
r AS (SELECT n.event_id, n.symbol, n.rn, (fast - slow) / (mid + 1e-8) AS macd, sig / (mid + 1e-8) AS macd_signal
  FROM n JOIN step s ON s.symbol = n.symbol AND s.i = n.rn - 1)""", recursive=True)

_WEIGHTS = ", ".join(f"{w!r}e0" if "e" not in repr(w) else repr(w) for w in T.frac_diff_weights())
indicator_query("tick_fracdiff", {"frac_diff": 6}, f""",
b AS (SELECT *, list(mid) OVER ({W} ROWS 59 PRECEDING) AS buf FROM n),
r AS (SELECT event_id, symbol, rn, CASE WHEN rn > 60
  THEN list_dot_product(list_reverse(buf), [{_WEIGHTS}]::DOUBLE[60]::DOUBLE[]) ELSE 0e0 END AS frac_diff
  FROM b)""")


@query("tick_vwap", with_views(["ticks"], f"""
w AS (SELECT *, CASE WHEN volume > 0 THEN volume ELSE 1e0 END AS q, CAST(ts AS DATE) AS session FROM ticks),
v AS (SELECT *, sum(mid * q) OVER s / sum(q) OVER s AS vwap FROM w
      WINDOW s AS (PARTITION BY symbol, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT event_id, symbol, vwap, greatest(-1e0, least(1e0, (mid - vwap) / (vwap + 1e-8))) AS vwap_dev FROM v)
SELECT event_id, symbol, {rounded_sql({"vwap": 6, "vwap_dev": 6})} FROM r"""))
def tick_vwap(spark, sf_dir):
    out = T.session_vwap(views.ticks(spark, sf_dir))
    return rounded(out.select("event_id", "symbol", "vwap", "vwap_dev"), {"vwap": 6, "vwap_dev": 6})


@query("tick_return_moments", with_views(["ticks"], f"""{NUMBERED},
l AS (SELECT *, ln(mid / prev) AS log_ret FROM n),
c AS (SELECT *, count(log_ret) OVER u AS cum_n, avg(log_ret) OVER u AS cum_mean, stddev_samp(log_ret) OVER u AS cum_sd
      FROM l WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)),
r AS (SELECT event_id, symbol, cum_n, cum_mean, cum_sd, CASE WHEN cum_n > 5 AND cum_sd > 1e-10
   THEN greatest(-10e0, least(10e0, (log_ret - cum_mean) / cum_sd)) ELSE 0e0 END AS z_price FROM c WHERE rn >= 2)
SELECT event_id, symbol, cum_n, {rounded_sql({"cum_mean": 6, "cum_sd": 6, "z_price": 6})} FROM r"""))
def tick_return_moments(spark, sf_dir):
    out = T.z_price_fallback(views.ticks(spark, sf_dir))
    return rounded(out.select("event_id", "symbol", "cum_n", "cum_mean", "cum_sd", "z_price"),
                   {"cum_mean": 6, "cum_sd": 6, "z_price": 6})


@query("tick_robust_z", with_views(["ticks"], f"""{NUMBERED},
l AS (SELECT symbol, list(mid ORDER BY rn) AS x FROM n GROUP BY symbol),
step(symbol, i, mu, var) AS (
  SELECT symbol, 1, x[1], 1e0 FROM l
  UNION ALL
  SELECT s.symbol, s.i + 1, s.mu + 0.02e0 * (l.x[s.i + 1] - s.mu),
         0.98e0 * (s.var + 0.02e0 * (l.x[s.i + 1] - s.mu) * (l.x[s.i + 1] - s.mu))
  FROM step s JOIN l USING (symbol) WHERE s.i < len(l.x)),
b AS (SELECT *, list(mid) OVER w AS buf, median(mid) OVER w AS med FROM n WINDOW w AS ({W} ROWS 199 PRECEDING)),
m AS (SELECT *, list_median(list_transform(buf, lambda v: abs(v - med))) AS mad FROM b),
g AS (SELECT m.*, mu, sqrt(var) AS sd,
      CASE WHEN mad > 1e-12 THEN 1.4826e0 * mad ELSE sqrt(var) END AS sigma
      FROM m JOIN step s ON s.symbol = m.symbol AND s.i = m.rn),
r AS (SELECT event_id, symbol, med AS price_mean, CASE WHEN rn < 2 THEN 1e0 ELSE sigma END AS price_std,
      greatest(-8e0, least(8e0, CASE WHEN rn >= 30 THEN (mid - med) / (sigma + 1e-12)
                                     ELSE (mid - mu) / (sd + 1e-12) END)) AS z_price FROM g)
SELECT event_id, symbol, {rounded_sql({"price_mean": 6, "price_std": 6, "z_price": 6})} FROM r""", recursive=True))
def tick_robust_z(spark, sf_dir):
    out = T.rolling_robust_z(views.ticks(spark, sf_dir))
    digits = {"price_mean": 6, "price_std": 6, "z_price": 6}
    return rounded(out.select("event_id", "symbol", *digits), digits)


@query("tick_vector", with_views(["ticks"], f"""{NUMBERED},
q AS (SELECT *, avg(mid) OVER (w ROWS 19 PRECEDING) AS mu, stddev_pop(mid) OVER (w ROWS 19 PRECEDING) + 1e-8 AS sd,
  avg(greatest(mid - prev, 0e0)) OVER (w ROWS 13 PRECEDING) AS g, avg(greatest(prev - mid, 0e0)) OVER (w ROWS 13 PRECEDING) AS l
  FROM n WINDOW w AS ({W})),
v AS (SELECT event_id, sum(mid * wt) OVER s / sum(wt) OVER s AS vwap FROM (
  SELECT *, CASE WHEN volume > 0 THEN volume ELSE 1e0 END AS wt, CAST(ts AS DATE) AS session FROM ticks)
  WINDOW s AS (PARTITION BY symbol, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT event_id, symbol, rn, CAST(21 AS INTEGER) AS width, (mid - prev) / prev AS v2,
  (CASE WHEN rn < 15 THEN 50e0 WHEN l < 1e-12 THEN 100e0 ELSE 100e0 - 100e0 / (1 + g / l) END - 50) / 50e0 AS v7,
  greatest(-1e0, least(1e0, (mid - vwap) / (vwap + 1e-8))) AS v9, spread / (mid + 1e-8) AS v10,
  CASE WHEN rn >= 20 THEN greatest(0e0, least(1e0, (mid - (mu - 2 * sd)) / (4 * sd))) ELSE 0.5e0 END * 2 - 1 AS v16
  FROM q JOIN v USING (event_id))
SELECT event_id, symbol, width, {rounded_sql({f"v{i}": 6 for i in (2, 7, 9, 10, 16)})} FROM r WHERE rn >= 2"""))
def tick_vector(spark, sf_dir):
    out = T.tick_features(views.ticks(spark, sf_dir))
    at = (2, 7, 9, 10, 16)
    out = out.select("event_id", "symbol", F.size("vector").alias("width"),
                     *[F.get("vector", i - 1).alias(f"v{i}") for i in at])
    return rounded(out, {f"v{i}": 6 for i in at})
