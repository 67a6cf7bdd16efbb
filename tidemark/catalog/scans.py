"""Sequential queries: filters, variance, regimes, causal weights, residual bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import ORACLES, query, rounded, rounded_sql, with_views
from tidemark.catalog.ticks import NUMBERED
from tidemark.functions.numeric import d
from tidemark.operators import calibrate, causal, scans
from tidemark.operators import ticks as T
from tidemark.operators.blocks import Order, block_window, own_rows, ticks_order, with_blocks




# Written out here as well, so that the comparison doesn't rest on the module it checks.
FACTORS_SQL = """(VALUES ('momentum_short', 0.30e0), ('market_microstructure', 0.28e0), ('volatility_state', 0.25e0),
  ('sentiment', 0.22e0), ('mean_reversion', 0.20e0), ('risk_regime', 0.15e0), ('dollar_strength', 0.12e0),
  ('yield_pressure', 0.10e0), ('liquidity', 0.10e0), ('inflation_pressure', 0.08e0), ('macro_shock', 0.08e0),
  ('positioning_bias', 0.07e0), ('options_skew', 0.07e0), ('momentum_long', 0.07e0), ('geopolitical_risk', 0.05e0),
  ('carry', 0.05e0))"""


def filter_sql(source: str, q: str, r: str, p0: str, start: str, low: str = "0e0", high: str = "1e300", extra: str = "0e0",
               columns: str = "") -> str:
    """Filter recursion over `source` (symbol, ids, x and `columns`), one step per row, with the variance carried on."""
    pred = f"(p + {q})"
    gain = f"{pred} / ({pred} + {r} + {extra})"
    carried = f"{columns}, " if columns else ""
    names = [c.strip() for c in columns.split(",") if c.strip()]
    step = lambda x: f"s + ({gain}) * ({x} - s) AS s, least(greatest((1 - {gain}) * {pred}, {low}), {high}) AS p"
    return f"""
step({carried}symbol, i, s, p) AS (
  SELECT {carried}symbol, 1, {step("x[1]")} FROM (SELECT *, {start} AS s, {p0} AS p FROM {source})
  UNION ALL
  SELECT {carried}symbol, i + 1, {step("v")} FROM (
    SELECT {"".join(f"t.{c}, " for c in names)}t.symbol, t.i, t.s, t.p, l.x[t.i + 1] AS v
    FROM step t JOIN l ON l.symbol = t.symbol WHERE t.i < len(l.x)))"""


@query("kalman_confidence", with_views(["ticks"], NUMBERED.strip() + f""",
l AS (SELECT symbol, list(volume / 97e0 ORDER BY rn) AS x, list(event_id ORDER BY rn) AS ids FROM n GROUP BY symbol),
{filter_sql("l", "0.001e0", "0.05e0", "0.1e0", "0.55e0")},
r AS (SELECT ids[i] AS event_id, symbol, greatest(0.1e0, least(0.99e0, s)) AS value FROM step JOIN l USING (symbol))
SELECT event_id, symbol, {rounded_sql({"value": 6})} FROM r""", recursive=True))
def kalman_confidence(spark, sf_dir, **size):
    t = T.valid_ticks(views.ticks(spark, sf_dir)).withColumn("obs", F.col("volume") / 97.0)
    out = scans.kalman_confidence(t, "obs", ticks_order(), **size).withColumnRenamed("confidence", "value")
    return rounded(out.select("event_id", "symbol", "value"), {"value": 6})


@query("kalman_factor", with_views(["ticks"], NUMBERED.strip() + f""",
l AS (SELECT symbol, list(tanh(mid / 1e2) ORDER BY rn) AS x, list(event_id ORDER BY rn) AS ids FROM n GROUP BY symbol),
f AS (SELECT * FROM l, {FACTORS_SQL} v(factor, speed)),
{filter_sql("f", "0.05e0 * speed", "(0.5e0 - 0.3e0 * speed)", "0.5e0", "0e0", "1e-4", "2e0", "1e-8", "factor, speed")},
r AS (SELECT ids[i] AS event_id, symbol, factor, s AS value FROM step JOIN l USING (symbol))
SELECT event_id, symbol, factor, {rounded_sql({"value": 6})} FROM r""", recursive=True))
def kalman_factor(spark, sf_dir):
    """All factors of one measurement, a row per tick and factor."""
    t = T.valid_ticks(views.ticks(spark, sf_dir)).withColumn("m", F.tanh(F.col("mid") / 100.0))
    out = scans.kalman_factors(t, {f: "m" for f in scans.FACTOR_SPEED}, ticks_order())
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"factor_{f}").alias("value"))
                               for f in scans.FACTOR_SPEED])).alias("f")
    return rounded(out.select("event_id", "symbol", each).select("event_id", "symbol", "f.*"), {"value": 6})


def returns(spark, sf_dir):
    """Numbered ticks with returns scaled to market size."""
    return T.log_returns(views.ticks(spark, sf_dir)).withColumn("log_ret", F.col("log_ret") / 100.0)


@query("garch", with_views(["ticks"], NUMBERED.strip() + f""",
l AS (SELECT symbol, list(event_id ORDER BY rn) AS ids, list(ln(mid / prev) / 1e2 ORDER BY rn) AS x FROM n GROUP BY symbol),
step(symbol, i, w, a, b, s2, r2) AS (
  SELECT symbol, 1, 1e-8, 0.08e0, 0.9e0, 1e-6, 0e0 FROM l
  UNION ALL
  SELECT symbol, i, w, CASE WHEN a + b >= 0.999e0 THEN a * (0.999e0 / (a + b)) ELSE a END,
         CASE WHEN a + b >= 0.999e0 THEN b * (0.999e0 / (a + b)) ELSE b END, s2, r2 FROM (
    SELECT symbol, i, least(greatest(w - g, 1e-12), 1e-2) AS w, least(greatest(a - g * r2, 0.001e0), 0.3e0) AS a,
           least(greatest(b - g * s2, 0.5e0), 0.998e0) AS b, p AS s2, r * r AS r2 FROM (
      SELECT *, 5e-4 * (0.5e0 * (1e0 / p - r * r / (p * p))) AS g FROM (
        SELECT s.symbol, s.i + 1 AS i, w, a, b, s2, r2, l.x[s.i + 1] AS r, greatest(w + a * r2 + b * s2, 1e-12) AS p
        FROM step s JOIN l USING (symbol) WHERE s.i < len(l.x))))),
r AS (SELECT l.ids[i] AS event_id, symbol, sqrt(greatest(s2, 1e-12)) AS sigma, w AS omega, a AS alpha, b AS beta
      FROM step JOIN l USING (symbol))
SELECT event_id, symbol, {rounded_sql({"sigma": 6, "omega": 6, "alpha": 6, "beta": 6})} FROM r""", recursive=True))
def garch(spark, sf_dir, **size):
    out = scans.speculative_scan(returns(spark, sf_dir).select("event_id", "symbol", "rn", "log_ret"), scans.garch_scan(),
                                 ticks_order(), **size)
    digits = {"sigma": 6, "omega": 6, "alpha": 6, "beta": 6}
    return rounded(out.select("event_id", "symbol", *digits), digits)


FACTORS = {
    "risk_regime": "mid / (mid + 50e0)", "volatility_state": "spread / (spread + 0.05e0)", "momentum_short": "volume / 97e0",
    "momentum_long": "(event_id % 89) / 89e0", "liquidity": "(event_id % 73) / 73e0", "mean_reversion": "(event_id % 61) / 61e0",
}


def _regime_sql() -> str:
    """Levels by windows, scores by row, then the blend one step per row."""
    levels = ", ".join(f"CASE WHEN rn < 30 THEN {d0}e0 ELSE quantile_cont({c}, {q}) OVER w END AS h{i}"
                       for i, (c, q, d0) in enumerate(scans.REGIME_LEVELS))
    nxt = [f"0.4e0 * l.s{j}[s.i + 1] + 0.6e0 * s.c{j} + CASE WHEN s.cur = {j} THEN 0.05e0 ELSE 0e0 END" for j in range(4)]
    first = [f"0.4e0 * s{j}[1] + 0.6e0 * 0.25e0" + (" + 0.05e0" if j == 3 else "") for j in range(4)]
    best = "CASE greatest(c0, c1, c2, c3) WHEN c0 THEN 0 WHEN c1 THEN 1 WHEN c2 THEN 2 ELSE 3 END"
    names = ", ".join(f"'{r}'" for r in scans.REGIMES)
    return f""",
f AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in FACTORS.items())} FROM n),
h AS (SELECT *, {levels} FROM f WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 499 PRECEDING)),
sc AS (SELECT symbol, event_id, rn,
  greatest(0e0, (risk_regime - h0) + (h3 - volatility_state) + (liquidity - h6)) AS s0,
  greatest(0e0, (h1 - risk_regime) + (volatility_state - h2)) AS s1,
  greatest(0e0, (momentum_short - h4) + (momentum_long - h5)) AS s2, greatest(0e0, (mean_reversion - h7) + 0.1e0) AS s3 FROM h),
l AS (SELECT symbol, list(event_id ORDER BY rn) AS ids, {", ".join(f"list(s{j} ORDER BY rn) AS s{j}" for j in range(4))}
      FROM sc GROUP BY symbol),
step(symbol, i, c0, c1, c2, c3, cur) AS (
  SELECT *, {best} FROM (SELECT symbol, 1 AS i, {", ".join(f"{e} AS c{j}" for j, e in enumerate(first))} FROM l)
  UNION ALL
  SELECT *, {best} FROM (SELECT s.symbol, s.i + 1 AS i, {", ".join(f"{e} AS c{j}" for j, e in enumerate(nxt))}
    FROM step s JOIN l USING (symbol) WHERE s.i < len(l.ids))),
r AS (SELECT l.ids[i] AS event_id, symbol, [{names}][cur + 1] AS regime, 1e0 / (exp(c0 - greatest(c0, c1, c2, c3))
   + exp(c1 - greatest(c0, c1, c2, c3)) + exp(c2 - greatest(c0, c1, c2, c3)) + exp(c3 - greatest(c0, c1, c2, c3)))
   AS regime_confidence FROM step JOIN l USING (symbol))
SELECT event_id, symbol, regime, {rounded_sql({"regime_confidence": 6})} FROM r"""


@query("regime_sticky", with_views(["ticks"], NUMBERED.strip() + _regime_sql(), recursive=True))
def regime_sticky(spark, sf_dir, **size):
    t = T.numbered_ticks(views.ticks(spark, sf_dir))
    rows = t.select("event_id", "symbol", "rn", *[F.expr(e).alias(c) for c, e in FACTORS.items()])
    out = scans.with_regime(scans.speculative_scan(rows, scans.regime_scan(), ticks_order(), **size))
    return rounded(out.select("event_id", "symbol", "regime", "regime_confidence"), {"regime_confidence": 6})


@query("regime_levels", with_views(["ticks"], """
f AS (SELECT event_id, event_id % 97 / 97e0 AS a, event_id % 89 / 89e0 AS b, event_id % 83 / 83e0 AS c,
        event_id % 79 / 79e0 AS e, event_id % 73 / 73e0 AS g FROM ticks)
SELECT event_id, CASE WHEN a > 0.65 AND b < 0.4 AND g > 0.5 THEN 'RISK-ON' WHEN a < 0.35 OR b > 0.7 THEN 'RISK-OFF'
  WHEN c > 0.6 AND e > 0.55 THEN 'TRENDING' ELSE 'RANGING' END AS regime FROM f"""))
def regime_levels(spark, sf_dir):
    i = F.col("event_id")
    t = views.ticks(spark, sf_dir).select(
        "event_id", (i % 97 / 97.0).alias("risk_regime"), (i % 89 / 89.0).alias("volatility_state"),
        (i % 83 / 83.0).alias("momentum_short"), (i % 79 / 79.0).alias("momentum_long"), (i % 73 / 73.0).alias("liquidity"))
    return t.select("event_id", scans.regime_of_levels().alias("regime"))


@query("session_vwap_elapsed", with_views(["ticks"], NUMBERED.strip() + f""",
l AS (SELECT symbol, list(event_id ORDER BY rn) AS ids, list(epoch_us(ts) / 1e6 ORDER BY rn) AS t,
        list(mid ORDER BY rn) AS x, list(CASE WHEN volume > 0 THEN volume ELSE 1e0 END ORDER BY rn) AS q FROM n GROUP BY symbol),
step(symbol, i, start, pv, vv) AS (
  SELECT symbol, 1, t[1], x[1] * q[1], q[1] FROM l
  UNION ALL
  SELECT s.symbol, s.i + 1, CASE WHEN t[s.i + 1] - start > 86400 THEN t[s.i + 1] ELSE start END,
    CASE WHEN t[s.i + 1] - start > 86400 THEN 0e0 ELSE pv END + x[s.i + 1] * q[s.i + 1],
    CASE WHEN t[s.i + 1] - start > 86400 THEN 0e0 ELSE vv END + q[s.i + 1]
  FROM step s JOIN l USING (symbol) WHERE s.i < len(l.x)),
r AS (SELECT l.ids[i] AS event_id, symbol, pv / vv AS vwap,
        greatest(-1e0, least(1e0, (l.x[i] - pv / vv) / (pv / vv + 1e-8))) AS vwap_dev FROM step JOIN l USING (symbol))
SELECT event_id, symbol, {rounded_sql({"vwap": 6, "vwap_dev": 6})} FROM r""", recursive=True))
def session_vwap_elapsed(spark, sf_dir, **size):
    t = T.numbered_ticks(views.ticks(spark, sf_dir)).select(
        "event_id", "symbol", "rn", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), "mid", "volume")
    out = scans.carried_scan(t, scans.session_scan(), ticks_order(), **size)
    return rounded(out.select("event_id", "symbol", "vwap", "vwap_dev"), {"vwap": 6, "vwap_dev": 6})


def edges(spark, sf_dir):
    """Daily closes of the other four series against the target's, one edge each."""
    p = views.prices_d(spark, sf_dir)
    gold = p.where(F.col("symbol") == "GC=F").select("date", F.col("close").alias("y"))
    name = F.create_map(*[F.lit(x) for x in ("DX-Y.NYB", "DXY", "^VIX", "VIX", "CL=F", "OIL", "SLV", "INFLATION")])[F.col("symbol")]
    return p.withColumn("cause", name).where(F.col("cause").isNotNull()).select(
        "date", "cause", F.col("close").alias("x")).join(gold, "date")


def _weights(spark, sf_dir, **options):
    order = Order(("cause",), ("date",), F.year("date").cast("long"))
    out = causal.granger_weights(edges(spark, sf_dir), order, size=256, **options)
    return rounded(out.select("cause", F.col("date").cast("string").alias("date"), "weight", "smoothed"),
                   {"weight": 6, "smoothed": 6})


@query("granger")
def granger(spark, sf_dir):
    return _weights(spark, sf_dir)


@query("granger_one_lag", with_views(["prices_d"], f"""
c AS (SELECT CASE x.symbol WHEN 'DX-Y.NYB' THEN 'DXY' WHEN '^VIX' THEN 'VIX' WHEN 'CL=F' THEN 'OIL'
    ELSE 'INFLATION' END AS cause, x.date, x.close AS x, y.close AS y
  FROM prices_d x JOIN prices_d y ON y.date = x.date AND y.symbol = 'GC=F' WHERE x.symbol <> 'GC=F'),
n AS (SELECT *, row_number() OVER w AS rn, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM c WINDOW w AS (PARTITION BY cause ORDER BY date)),
z AS (SELECT *, lag(dx) OVER w AS dx1, lag(dy) OVER w AS dy1 FROM n WINDOW w AS (PARTITION BY cause ORDER BY rn)),
m AS (SELECT cause, date, rn, avg(dy) OVER w AS my, avg(dy1) OVER w AS m1, avg(dx1) OVER w AS m2,
    covar_pop(dy, dy1) OVER w AS c01, covar_pop(dy, dx1) OVER w AS c02, covar_pop(dy1, dx1) OVER w AS c12,
    var_pop(dy1) OVER w AS v1, var_pop(dx1) OVER w AS v2, count(*) OVER w AS t
  FROM z WHERE dy1 IS NOT NULL WINDOW w AS (PARTITION BY cause ORDER BY rn ROWS 117 PRECEDING)),
b AS (SELECT *, (c01 * v2 - c02 * c12) / (v1 * v2 - c12 * c12) AS b1, (c02 * v1 - c01 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m
  WHERE rn >= 18),
e AS (SELECT b.cause, b.rn, t, power(z.dy - my - c01 / v1 * (z.dy1 - m1), 2) AS own, power(z.dy - my - b1 * (z.dy1 - m1) - b2 * (z.dx1 - m2), 2) AS full_
  FROM b JOIN z ON z.cause = b.cause AND z.rn BETWEEN greatest(b.rn - 117, 3) AND b.rn),
g AS (SELECT cause, rn, sum(own) AS ro, sum(full_) AS rb, (sum(own) - sum(full_)) / (sum(full_) / greatest(max(t) - 3, 1)) AS f,
  corr(own, full_) AS r, stddev_pop(own) AS so, stddev_pop(full_) AS sb FROM e GROUP BY ALL),
wt AS (SELECT cause, rn, CASE WHEN least(ro, rb) < 1e-12 OR NOT f > 0 THEN 0.5e0 ELSE least(1e0, 1 / (1 + exp(2 - f))
  + CASE WHEN so > 1e-8 AND sb > 1e-8 THEN greatest(0e0, abs(r) - 0.3e0) * 0.2e0 ELSE 0e0 END) END AS weight FROM g),
l AS (SELECT cause, list(weight ORDER BY rn) AS w, CASE cause WHEN 'DXY' THEN 0.12e0 WHEN 'VIX' THEN 0.18e0 WHEN 'OIL' THEN 0.1e0 ELSE 0.06e0 END AS speed
  FROM wt GROUP BY cause),
step(cause, i, s) AS (SELECT cause, 1, 0.5e0 + speed * (w[1] - 0.5e0) FROM l
  UNION ALL SELECT t.cause, t.i + 1, t.s + speed * (w[t.i + 1] - t.s) FROM step t JOIN l USING (cause) WHERE t.i < len(w)),
r AS (SELECT wt.cause, CAST(n.date AS VARCHAR) AS date, weight, s AS smoothed FROM wt JOIN n USING (cause, rn)
  JOIN step ON step.cause = wt.cause AND step.i = wt.rn - 17)
SELECT cause, date, {rounded_sql({"weight": 6, "smoothed": 6})} FROM r""", recursive=True))
def granger_one_lag(spark, sf_dir):
    """The same edges with one lag, whose regressions SQL can state."""
    return _weights(spark, sf_dir, longest=1)


@query("lagged_return_row", with_views(["ticks"], NUMBERED.strip() + f""",
x AS (SELECT event_id, symbol, rn, ln(mid / prev) / 1e2 AS lr FROM n),
b AS (SELECT event_id, symbol, rn, list(greatest(-0.05e0, least(0.05e0, lr))) FILTER (lr IS NOT NULL)
        OVER (PARTITION BY symbol ORDER BY rn ROWS 59 PRECEDING) AS v FROM x),
r AS (SELECT event_id, symbol, CASE WHEN rn > 60 THEN v[1] ELSE 0e0 END AS oldest, coalesce(v[-1], 0e0) AS newest,
        coalesce(list_sum(v), 0e0) AS total, CAST(61 AS INTEGER) AS width FROM b)
SELECT event_id, symbol, width, {rounded_sql({"oldest": 6, "newest": 6, "total": 6})} FROM r"""))
def lagged_return_row(spark, sf_dir):
    out = scans.lagged_return_row(returns(spark, sf_dir), ticks_order(), states=("spread",))
    v = F.col("features")
    out = out.select("event_id", "symbol", F.size(v).alias("width"), F.get(v, 0).alias("oldest"), F.get(v, 59).alias("newest"),
                     F.aggregate(F.slice(v, 1, 60), d(0), lambda a, x: a + x).alias("total"))
    return rounded(out, {"oldest": 6, "newest": 6, "total": 6})


RESID = {f"resid_{q}": 6 for q in calibrate.BAND}


@query("residual_quantiles", with_views(["ticks"], NUMBERED.strip() + f""",
x AS (SELECT event_id, symbol, rn, spread AS sg, CASE WHEN volume > 20 THEN
        ln(mid / lag(mid, 5) OVER o) / (lag(spread, 5) OVER o + 1e-8) END AS res
      FROM n WINDOW o AS (PARTITION BY symbol ORDER BY rn)),
q AS (SELECT symbol, rn, count(*) OVER w AS k, {", ".join(f"quantile_cont(res, {t}) OVER w AS e_{n}" for n, t in
      zip(calibrate.BAND, (0.1, 0.25, 0.5, 0.75, 0.9)))} FROM x WHERE res IS NOT NULL
      WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 511 PRECEDING)),
r AS (SELECT event_id, x.symbol, {", ".join(f"(CASE WHEN k >= 16 THEN e_{n} ELSE {z}e0 END) * sg * sqrt(5e0) AS resid_{n}"
      for n, z in zip(calibrate.BAND, calibrate.NORMAL_Z))}
      FROM x ASOF LEFT JOIN q ON x.symbol = q.symbol AND x.rn >= q.rn)
SELECT event_id, symbol, {rounded_sql(RESID)} FROM r"""))
def residual_quantiles(spark, sf_dir):
    """The error of a forecast of no change over five ticks, known at the fifth, and only on ticks of some volume."""
    t = T.numbered_ticks(views.ticks(spark, sf_dir))
    w = block_window(("symbol",))
    made = own_rows(with_blocks(t, 16384, 5).withColumns({"_mid": F.lag("mid", 5).over(w), "_spread": F.lag("spread", 5).over(w)}))
    error = F.log(F.col("mid") / F.col("_mid")) / (F.col("_spread") + 1e-8)
    t = made.withColumn("residual", F.when(F.col("volume") > 20, error)).drop("_mid", "_spread")
    out = calibrate.rolling_residual_quantiles(t, "residual", "spread", 5, ticks_order())
    return rounded(out.select("event_id", "symbol", *RESID), RESID)


@query("attention_weights", f"""
WITH RECURSIVE e AS (SELECT event_type AS modality, event_id, least(5e0, abs(value / 1e2 - 1e0)) AS err,
   row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
l AS (SELECT modality, list(err ORDER BY rn) AS x, list(event_id ORDER BY rn) AS ids FROM e GROUP BY modality),
step(modality, i, s) AS (SELECT modality, 1, 0.92e0 * 0.1e0 + 0.08e0 * x[1] FROM l
  UNION ALL SELECT s.modality, s.i + 1, 0.92e0 * s.s + 0.08e0 * l.x[s.i + 1] FROM step s JOIN l USING (modality)
  WHERE s.i < len(l.x)),
r AS (SELECT l.ids[i] AS event_id, modality, s AS err_avg FROM step JOIN l USING (modality))
SELECT event_id, modality, {rounded_sql({"err_avg": 6})} FROM r""")
def attention_weights(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("modality"), (F.col("value") / 100.0 - 1).alias("err"))
    out = T.modality_error_average(e, "err")
    return rounded(out.select("event_id", "modality", "err_avg"), {"err_avg": 6})


@query("attention_softmax", """
WITH e AS (SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'click') AS market,
  avg(value) FILTER (event_type = 'view') AS macro, avg(value) FILTER (event_type = 'signup') AS sentiment,
  avg(value) FILTER (event_type = 'purchase') AS events FROM events GROUP BY 1),
l AS (SELECT day, exp(-ln(market + 1e-3) / 2e0) AS a, exp(-ln(macro + 1e-3) / 2e0) AS b,
  exp(-ln(sentiment + 1e-3) / 2e0) AS c, exp(-ln(events + 1e-3) / 2e0) AS d FROM e)
SELECT CAST(day AS VARCHAR) AS day, round(a / (a + b + c + d), 6) AS market, round(b / (a + b + c + d), 6) AS macro,
  round(c / (a + b + c + d), 6) AS sentiment, round(d / (a + b + c + d), 6) AS events FROM l""")
def attention_softmax(spark, sf_dir):
    kinds = {"market": "click", "macro": "view", "sentiment": "signup", "events": "purchase"}
    e = views.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(*[
        F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(m) for m, k in kinds.items()])
    weights = T.attention_weights({m: F.col(m) for m in kinds})
    out = e.select(F.col("day").cast("string").alias("day"), *[c.alias(m) for m, c in weights.items()])
    return rounded(out, {m: 6 for m in kinds})


@query("modality_errors", with_views(["ticks"], """
r AS (SELECT event_id, ln(lead(mid, 5) OVER (PARTITION BY symbol ORDER BY ts, event_id) / mid) AS e, spread, volume FROM ticks)
SELECT event_id, 'market' AS modality, round(abs(e) * spread, 6) AS attributed_error FROM r WHERE e IS NOT NULL
UNION ALL SELECT event_id, 'macro', round(abs(e) * volume, 6) FROM r WHERE e IS NOT NULL"""))
def modality_errors(spark, sf_dir):
    from tidemark.operators.align import tick_horizon

    t = tick_horizon(T.numbered_ticks(views.ticks(spark, sf_dir)), (5,), ticks_order())
    rows = t.select("event_id", "realised_5", "spread", "volume")
    out = scans.modality_errors(rows, {"market": "spread", "macro": "volume"}, "realised_5")
    return rounded(out.select("event_id", "modality", "attributed_error"), {"attributed_error": 6})


# Blocks far smaller than the default, so that small data cross their seams too.

@query("garch_small_blocks", ORACLES["garch"])
def garch_small_blocks(spark, sf_dir):
    return garch(spark, sf_dir, size=256, warmup=128)


@query("regime_sticky_small_blocks", ORACLES["regime_sticky"])
def regime_sticky_small_blocks(spark, sf_dir):
    return regime_sticky(spark, sf_dir, size=512)


@query("session_vwap_small_blocks", ORACLES["session_vwap_elapsed"])
def session_vwap_small_blocks(spark, sf_dir):
    return session_vwap_elapsed(spark, sf_dir, size=256, warmup=128)


@query("kalman_confidence_small_blocks", ORACLES["kalman_confidence"])
def kalman_confidence_small_blocks(spark, sf_dir):
    return kalman_confidence(spark, sf_dir, size=256)
