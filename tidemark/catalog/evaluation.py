"""Evaluation queries: folds, backtest metrics, calibration, drift, promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views
from tidemark.catalog.daily import dated, yz_sql
from tidemark.functions.numeric import SQRT_YEAR, Z10
from tidemark.operators import backtest as B
from tidemark.operators import calibrate, drift, metrics, robust
from tidemark.plans import panel as P
from tidemark.plans import settle as S

WALK = B.Walk(train=504, test=63, embargo=5, horizon=20)
LABEL = "target_logret_20d"


def daily(spark, sf_dir):
    """Per symbol and day: returns, label, 20-day volatility; the forecast is minus a tenth of momentum."""
    p = views.prices_d(spark, sf_dir)
    out = P.returns_and_labels(P.yang_zhang(p, (20,)))
    return out.select("date", "symbol", "close", "logret_1d", "logret_5d", "logret_20d", LABEL, "yz_20")


def forecast():
    return F.coalesce(F.col("logret_20d"), F.lit(0.0)) * -0.1


DAILY = f"""
prices AS (SELECT * FROM prices_d),{yz_sql((20,))},
daily AS (SELECT p.date, p.symbol, p.close, yz_20,
  ln(close) - lag(ln(close), 1) OVER w AS logret_1d, ln(close) - lag(ln(close), 5) OVER w AS logret_5d,
  ln(close) - lag(ln(close), 20) OVER w AS logret_20d, lead(ln(close), 20) OVER w - ln(close) AS {LABEL}
  FROM prices p JOIN yz ON yz.date = p.date AND yz.symbol = p.symbol
  WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date))"""

ROWS = f"""{DAILY},
num AS (SELECT *, coalesce(logret_20d, 0e0) * -0.1e0 AS pred,
   row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n
   FROM daily WHERE {LABEL} IS NOT NULL),
fold AS (SELECT symbol, k AS fold, {WALK.train} + k * {WALK.test} AS test_start,
   {WALK.train} + (k + 1) * {WALK.test} AS test_end, {WALK.train} + k * {WALK.test} - {WALK.gap} AS train_end
   FROM (SELECT symbol, max(n) AS n FROM num GROUP BY symbol), range(0, 100000) r(k)
   WHERE {WALK.train} + (k + 1) * {WALK.test} <= n)"""

TRADES = f"""{ROWS},
thr AS (SELECT f.symbol, f.fold, quantile_cont(abs(pred), 0.3) AS threshold FROM fold f
   JOIN num ON num.symbol = f.symbol AND num.i < f.train_end GROUP BY ALL),
tst AS (SELECT num.*, f.fold, CASE WHEN abs(pred) < threshold THEN 0e0 ELSE sign(pred) END AS pos FROM num
   JOIN fold f ON num.symbol = f.symbol AND i >= test_start AND i < test_end
   JOIN thr ON thr.symbol = f.symbol AND thr.fold = f.fold),
trade AS (SELECT *, pos * {LABEL} - abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol, fold ORDER BY i), 0e0)) * 1e-4
   AS ret FROM tst)"""


def trades(spark, sf_dir):
    return B.run(daily(spark, sf_dir), LABEL, WALK, ["symbol"], forecast())


@query("walkforward_folds", with_views(["prices_d"], f"""{ROWS.strip()}
SELECT symbol, CAST(fold AS BIGINT) AS fold, CAST(train_end AS BIGINT) AS train_end,
  CAST(test_start AS BIGINT) AS test_start, CAST(test_end AS BIGINT) AS test_end FROM fold"""))
def walkforward_folds(spark, sf_dir):
    n = B.number_days(daily(spark, sf_dir), LABEL, ["symbol"]).groupBy("symbol").agg(F.max("n").alias("n"))
    return B.folds(n, WALK, ["symbol"])


@query("walkforward_train_rows", with_views(["prices_d"], f"""{ROWS.strip()}
SELECT f.symbol, CAST(fold AS BIGINT) AS fold, count(*) AS n_train, CAST(max(date) AS VARCHAR) AS last_date
FROM fold f JOIN num ON num.symbol = f.symbol AND num.i < f.train_end GROUP BY ALL"""))
def walkforward_train_rows(spark, sf_dir):
    rows = B.train_rows(B.number_days(daily(spark, sf_dir), LABEL, ["symbol"]), WALK)
    return rows.groupBy("symbol", "fold").agg(
        F.count("*").alias("n_train"), F.max("date").cast("string").alias("last_date"))


@query("backtest_trades", with_views(["prices_d"], f"""{TRADES.strip()}
SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(fold AS BIGINT) AS fold, pos, {rounded_sql({"ret": 6})} FROM trade"""))
def backtest_trades(spark, sf_dir):
    out = trades(spark, sf_dir).select("symbol", "date", "fold", "pos", "ret")
    return dated(rounded(out, {"ret": 6, "pos": 1}))


SHARPE = "CASE WHEN stddev_pop(ret) < 1e-12 THEN 0e0 ELSE avg(ret) / stddev_pop(ret) * sqrt({p}) END"


def _nw_sql(src: str, keys: str, lag: int) -> str:
    """Newey-West ratio by self-join on the row distance."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
e AS (SELECT {keys}, i, ret, ret - avg(ret) OVER (PARTITION BY {keys}) AS e,
      row_number() OVER (PARTITION BY {keys} ORDER BY i) AS t FROM {src}),
g AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.t - b.t AS k, sum(a.e * b.e) AS s FROM e a JOIN e b
      ON {on} AND a.t - b.t BETWEEN 1 AND {lag} GROUP BY ALL),
h AS (SELECT {keys}, sum((1 - k / ({lag} + 1e0)) * s) AS s FROM g GROUP BY ALL),
z AS (SELECT {', '.join('e.' + k.strip() for k in keys.split(','))}, count(*) AS n, avg(ret) AS mu, stddev_pop(ret) AS sd,
      sum(e * e) / count(*) + 2 * coalesce(max(h.s), 0) / count(*) AS var
      FROM e LEFT JOIN h USING ({keys}) GROUP BY ALL),
nw AS (SELECT {keys}, CASE WHEN n < {lag} + 2 OR sd < 1e-12 THEN 0e0
      ELSE mu / sqrt(greatest(var, 1e-12)) * sqrt(252e0) END AS sharpe_nw FROM z)"""


METRIC_DIGITS = {"hit_rate": 6, "pinball_q50": 6, "sharpe": 6, "sharpe_nw": 6}
FOLD_METRICS = f"""
fm AS (SELECT symbol, fold, min(date) AS test_start, max(date) AS test_end, count(*) AS n_test,
  avg(CASE WHEN sign({LABEL}) = sign(pred) THEN 1e0 ELSE 0e0 END) FILTER (pos <> 0) AS hit_rate,
  avg(greatest(0.5e0 * ({LABEL} - pred), -0.5e0 * ({LABEL} - pred))) AS pinball_q50, {SHARPE.format(p="252e0")} AS sharpe
  FROM trade GROUP BY symbol, fold)"""


@query("backtest_metrics", with_views(["prices_d"], f"""{TRADES.strip()},{_nw_sql("trade", "symbol, fold", 20)},{FOLD_METRICS}
SELECT symbol, CAST(fold AS BIGINT) AS fold, CAST(test_start AS VARCHAR) AS test_start,
  CAST(test_end AS VARCHAR) AS test_end, n_test, {rounded_sql(METRIC_DIGITS)} FROM fm JOIN nw USING (symbol, fold)"""))
def backtest_metrics(spark, sf_dir):
    out = B.fold_metrics(trades(spark, sf_dir), ["symbol"], LABEL, "pred", 20)
    return dated(rounded(out, METRIC_DIGITS), "test_start", "test_end")


OVERALL_DIGITS = {"overall_hit": 6, "overall_pin": 6, "sharpe_nw": 6, "sharpe_nonoverlap": 6}


@query("backtest_overall", with_views(["prices_d"], f"""{TRADES.strip()},{_nw_sql("trade", "symbol", 20)},{FOLD_METRICS},
no AS (SELECT symbol, {SHARPE.format(p="252e0 / 20")} AS sharpe_nonoverlap FROM (
  SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS j FROM trade) WHERE j % 20 = 0 GROUP BY 1),
ov AS (SELECT symbol, count(*) AS n_folds, avg(hit_rate) AS overall_hit, avg(pinball_q50) AS overall_pin FROM fm GROUP BY 1)
SELECT symbol, n_folds, {rounded_sql(OVERALL_DIGITS)} FROM ov JOIN nw USING (symbol) JOIN no USING (symbol)"""))
def backtest_overall(spark, sf_dir):
    t = trades(spark, sf_dir)
    out = B.overall(t, B.fold_metrics(t, ["symbol"], LABEL, "pred", 20), ["symbol"], 20)
    return rounded(out, OVERALL_DIGITS)


@query("backtest_newey_west", with_views(["prices_d"], f"""{DAILY.strip()},
r AS (SELECT symbol, date AS i, logret_20d AS ret FROM daily WHERE logret_20d IS NOT NULL),{_nw_sql("r", "symbol", 20)}
SELECT symbol, {rounded_sql({"sharpe_nw": 6})} FROM nw"""))
def backtest_newey_west(spark, sf_dir):
    out = metrics.newey_west_sharpe(daily(spark, sf_dir), "logret_20d", "date", ["symbol"], 20)
    return rounded(out, {"sharpe_nw": 6})


REGIME_DIGITS = {"hit": 6, "sharpe": 6, "mean_r": 6}


@query("backtest_by_regime", with_views(["prices_d"], f"""{TRADES.strip()},
q AS (SELECT symbol, quantile_cont(yz_20, 1e0 / 3) AS t33, quantile_cont(yz_20, 2e0 / 3) AS t67 FROM trade
      WHERE yz_20 IS NOT NULL GROUP BY 1),
b AS (SELECT t.*, CASE WHEN yz_20 <= t33 THEN 'low' WHEN yz_20 <= t67 THEN 'mid' ELSE 'high' END AS bucket
      FROM trade t JOIN q USING (symbol) WHERE yz_20 IS NOT NULL),
r AS (SELECT symbol, bucket, count(*) AS n, avg(CASE WHEN sign({LABEL}) = sign(pred) THEN 1e0 ELSE 0e0 END) AS hit,
      {SHARPE.format(p="252e0")} AS sharpe, avg(ret) AS mean_r FROM b GROUP BY ALL HAVING count(*) >= 5)
SELECT symbol, bucket, n, {rounded_sql(REGIME_DIGITS)} FROM r"""))
def backtest_by_regime(spark, sf_dir):
    out = metrics.by_tertile(trades(spark, sf_dir), "yz_20", "ret", LABEL, "pred", ["symbol"])
    return rounded(out, REGIME_DIGITS)


def _mixed_sql(x: str) -> str:
    """The integer hash of the resampling, over a column."""
    once = lambda v: f"((xor({v} >> 16, {v}) * 73244475) & 4294967295)"
    twice = once(once(x))
    return f"xor({twice} >> 16, {twice})"


BOOT_DIGITS = {"sharpe_med": 6, "sharpe_lo": 6, "sharpe_hi": 6}


@query("bootstrap_sharpe", with_views(["prices_d"], f"""{TRADES.strip()},
x AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n
  FROM trade),
draw AS (SELECT draw, {_mixed_sql("draw")} AS key FROM range(0, 1000) r(draw)),
spot AS (SELECT draw, pos, xor(key, pos) AS k FROM draw, range(0, (SELECT max(n) FROM x)) r(pos)),
u AS (SELECT draw, pos, {_mixed_sql("k")} AS u FROM spot),
w AS (SELECT draw, pos, u < 429496729 OR pos = 0 AS fresh, xor(u, 2654435769) AS v FROM u),
st AS (SELECT draw, pos, CASE WHEN fresh THEN {_mixed_sql("v")} END AS start, CASE WHEN fresh THEN pos END AS begun FROM w),
held AS (SELECT draw, pos, last_value(start IGNORE NULLS) OVER o AS start, last_value(begun IGNORE NULLS) OVER o AS begun
  FROM st WINDOW o AS (PARTITION BY draw ORDER BY pos)),
pick AS (SELECT c.symbol, draw, (start % n + held.pos - begun) % n AS pos FROM held
  JOIN (SELECT symbol, max(n) AS n FROM x GROUP BY 1) c ON held.pos < c.n AND c.n >= 30),
s AS (SELECT p.symbol, draw, CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(252e0) ELSE 0e0 END AS s
  FROM pick p JOIN x USING (symbol, pos) GROUP BY ALL
  UNION ALL SELECT symbol, 0, {SHARPE.format(p="252e0")} FROM x WHERE n < 30 GROUP BY 1),
r AS (SELECT symbol, median(s) AS sharpe_med, quantile_cont(s, 0.025) AS sharpe_lo, quantile_cont(s, 0.975) AS sharpe_hi
  FROM s GROUP BY 1)
SELECT symbol, {rounded_sql(BOOT_DIGITS)} FROM r"""))
def bootstrap_sharpe(spark, sf_dir):
    return rounded(metrics.bootstrap_sharpe(trades(spark, sf_dir), "ret", "i", ["symbol"]), BOOT_DIGITS)


FEATURES = ["logret_1d", "logret_5d", "logret_20d", "yz_20"]


@query("scaler_fit", with_views(["prices_d"], f"""{DAILY.strip()},
x AS (SELECT unnest(['logret_1d', 'logret_5d', 'logret_20d', 'yz_20']) AS feature,
        unnest([coalesce(logret_1d, 0e0), coalesce(logret_5d, 0e0), coalesce(logret_20d, 0e0), coalesce(yz_20, 0e0)]) AS v
      FROM daily),
m AS (SELECT feature, median(v) AS med FROM x GROUP BY 1),
r AS (SELECT feature, max(med) AS med, 1.4826e0 * median(abs(v - med)) AS mad FROM x JOIN m USING (feature) GROUP BY 1)
SELECT feature, round(med, 6) AS med, round(CASE WHEN mad < 1e-8 THEN 1e0 ELSE mad END, 6) AS mad FROM r"""))
def scaler_fit(spark, sf_dir):
    return rounded(robust.fit_scaler(daily(spark, sf_dir), FEATURES), {"med": 6, "mad": 6})


WINSOR = f"""{DAILY.strip()},
x AS (SELECT unnest(['logret_1d', 'logret_5d', 'logret_20d', 'yz_20']) AS feature,
        unnest([coalesce(logret_1d, 0e0), coalesce(logret_5d, 0e0), coalesce(logret_20d, 0e0), coalesce(yz_20, 0e0)]) AS v
      FROM daily),
w AS (SELECT feature, quantile_cont(v, 0.005) AS lo, CASE WHEN quantile_cont(v, 0.995) <= quantile_cont(v, 0.005)
        THEN quantile_cont(v, 0.005) + 1e-6 ELSE quantile_cont(v, 0.995) END AS hi FROM x GROUP BY 1)"""


@query("winsor_bounds", with_views(["prices_d"], f"""{WINSOR}
SELECT feature, {rounded_sql({"lo": 6, "hi": 6})} FROM w"""))
def winsor_bounds(spark, sf_dir):
    return rounded(robust.fit_winsor(daily(spark, sf_dir), FEATURES), {"lo": 6, "hi": 6})


@query("winsor_scale_apply", with_views(["prices_d"], f"""{WINSOR},
d AS (SELECT date, symbol, greatest(least(coalesce(logret_5d, 0e0), hi), lo) AS v FROM daily, w
      WHERE feature = 'logret_5d'),
m AS (SELECT median(v) AS med FROM d), s AS (SELECT 1.4826e0 * median(abs(v - med)) AS mad FROM d, m),
r AS (SELECT date, symbol, greatest(-8e0, least(8e0, (v - med) / CASE WHEN mad < 1e-8 THEN 1e0 ELSE mad END)) AS x
      FROM d, m, s)
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql({"x": 6})} FROM r"""))
def winsor_scale_apply(spark, sf_dir):
    rows = daily(spark, sf_dir).select("date", "symbol", F.col("logret_5d").alias("x"))
    cut = robust.apply_winsor(rows, ["x"], robust.fit_winsor(rows, ["x"]))
    return dated(rounded(robust.apply_scaler(cut, ["x"], robust.fit_scaler(cut, ["x"])), {"x": 6}))


@query("feature_coverage", with_views(["prices_d"], f"""{DAILY.strip()}
SELECT feature, round(coverage, 6) AS coverage FROM (
  SELECT unnest(['logret_1d', 'logret_5d', 'logret_20d', 'yz_20']) AS feature,
  unnest([count(logret_1d), count(logret_5d), count(logret_20d), count(yz_20)]) / CAST(count(*) AS DOUBLE) AS coverage
  FROM daily)"""))
def feature_coverage(spark, sf_dir):
    return rounded(robust.coverage(daily(spark, sf_dir), FEATURES), {"coverage": 6})


@query("conformal_scale", with_views(["prices_d"], f"""{DAILY.strip()},
r AS (SELECT symbol, quantile_cont(abs(({LABEL} + 0.1e0 * coalesce(logret_20d, 0e0)) / (yz_20 * sqrt(20e0) / sqrt(252e0) + 1e-8)),
   0.8) AS q, count(*) AS n FROM daily WHERE {LABEL} IS NOT NULL AND yz_20 IS NOT NULL GROUP BY symbol)
SELECT symbol, round(CASE WHEN n >= 10 THEN greatest(0.5e0, least(5e0, q / {Z10}e0)) ELSE 1e0 END, 6) AS conformal_scale
FROM r"""))
def conformal_scale(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumns({
        "mu": forecast(), "sigma": F.col("yz_20") * (20 ** 0.5) / SQRT_YEAR}).where(F.col(LABEL).isNotNull())
    return rounded(calibrate.conformal_scale(rows, LABEL, "mu", "sigma", by=["symbol"]), {"conformal_scale": 6})


BANDS = {c: 6 for c in ("q10", "q25", "q50", "q75", "q90")}


@query("forecast_band", with_views(["prices_d"], f"""{DAILY.strip()},
m AS (SELECT date, symbol, close, coalesce(logret_20d, 0e0) * -0.1e0 AS mu, yz_20 * sqrt(20e0) / sqrt(252e0) AS s FROM daily),
r AS (SELECT date, symbol, mu - 1.2816e0 * s AS q10, mu - 0.6745e0 * s AS q25, mu AS q50, mu + 0.6745e0 * s AS q75,
   mu + 1.2816e0 * s AS q90, greatest(0.05e0, least(0.99e0, exp(-0.5e0 * ln(s * s)))) AS confidence
   FROM m WHERE s > 0)
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql({**BANDS, "confidence": 6})} FROM r"""))
def forecast_band(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumns({
        "mu": forecast(), "s": F.col("yz_20") * (20 ** 0.5) / SQRT_YEAR}).where(F.col("s") > 0)
    q = calibrate.band(F.col("mu"), F.col("s"))
    conf = calibrate.confidence(F.log(F.col("s") * F.col("s")))
    out = rows.select("date", "symbol", *[c.alias(n) for n, c in q.items()], conf.alias("confidence"))
    return dated(rounded(out, {**BANDS, "confidence": 6}))


@query("band_coverage_loss", with_views(["prices_d"], f"""{DAILY.strip()},
m AS (SELECT symbol, {LABEL} AS y, coalesce(logret_20d, 0e0) * -0.1e0 AS mu, yz_20 * sqrt(20e0) / sqrt(252e0) AS s
      FROM daily WHERE {LABEL} IS NOT NULL AND yz_20 > 0),
b AS (SELECT *, ln(s * s) AS lv, unnest([-1.2816e0, -0.6745e0, 0e0, 0.6745e0, 1.2816e0]) AS z,
      unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) AS t FROM m),
p AS (SELECT symbol, avg(greatest(t * (y - mu - z * s), (t - 1) * (y - mu - z * s))) AS pinball FROM b GROUP BY 1),
c AS (SELECT symbol, avg(CASE WHEN y BETWEEN mu - 1.2816e0 * s AND mu + 1.2816e0 * s THEN 1e0 ELSE 0e0 END) AS cover,
      avg(0.5e0 * (ln(s * s) + (y - mu) * (y - mu) * exp(-ln(s * s)))) AS nll, avg(greatest(-mu * y, 0e0)) AS direction
      FROM m GROUP BY 1),
r AS (SELECT *, pinball + 0.3e0 * nll + 0.1e0 * direction AS total FROM p JOIN c USING (symbol))
SELECT symbol, {rounded_sql({"pinball": 6, "cover": 6, "nll": 6, "direction": 6, "total": 6})} FROM r"""))
def band_coverage_loss(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumns({
        "mu": forecast(), "s": F.col("yz_20") * (20 ** 0.5) / SQRT_YEAR})
    rows = rows.where((F.col("s") > 0) & F.col(LABEL).isNotNull()).withColumn("log_var", F.log(F.col("s") * F.col("s")))
    rows = rows.withColumns(calibrate.band(F.col("mu"), F.col("s")))
    loss = metrics.loss_report(rows, LABEL, by=["symbol"])
    cover = rows.groupBy("symbol").agg(metrics.coverage(F.col(LABEL), F.col("q10"), F.col("q90")).alias("cover"))
    return rounded(loss.join(cover, "symbol"), {"pinball": 6, "cover": 6, "nll": 6, "direction": 6, "total": 6})


SPLIT = "2000-01-01"


@query("ks_drift", with_views(["prices_d"], f"""{DAILY.strip()},
x AS (SELECT unnest(['logret_1d', 'logret_5d', 'logret_20d', 'yz_20']) AS feature,
        unnest([logret_1d, logret_5d, logret_20d, yz_20]) AS v, date >= DATE '{SPLIT}' AS recent FROM daily),
k AS (SELECT feature, v, count(*) FILTER (NOT recent) AS a, count(*) FILTER (recent) AS b FROM x
      WHERE v IS NOT NULL GROUP BY 1, 2),
c AS (SELECT feature, sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM k
      WINDOW u AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
s AS (SELECT feature, max(abs(ca / CAST(na AS DOUBLE) - cb / CAST(nb AS DOUBLE))) AS d_stat, max(na) AS na, max(nb) AS nb
      FROM c WHERE na >= 30 AND nb >= 20 GROUP BY 1),
t AS (SELECT *, sqrt(CAST(na AS DOUBLE) * nb / (na + nb)) * d_stat AS t FROM s),
q AS (SELECT *, CASE WHEN t < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0, 2 * list_sum(list_transform(range(1, 101),
      lambda k: (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * k * k * t * t))))) END AS p_value FROM t)
SELECT feature, CAST(na AS BIGINT) AS n_base, CAST(nb AS BIGINT) AS n_recent,
  {rounded_sql({"d_stat": 6, "p_value": 6})}, p_value < 0.01 OR d_stat > 0.15 AS drifted FROM q"""))
def ks_drift(spark, sf_dir):
    rows = daily(spark, sf_dir)
    cut = F.lit(SPLIT).cast("date")
    out = drift.ks_drift(rows.where(F.col("date") < cut), rows.where(F.col("date") >= cut), FEATURES)
    return rounded(out, {"d_stat": 6, "p_value": 6})


IMPORTANCE = {"logret_1d": -0.3, "logret_5d": -0.2, "logret_20d": -0.1, "yz_20": 0.0}


def _median_loss(entries: list[str]) -> str:
    score = " + ".join(f"{w}e0 * {e}" for w, e in zip(IMPORTANCE.values(), entries))
    return f"avg(0.5e0 * abs(y - ({score})))"


@query("permutation_importance", with_views(["prices_d"], f"""{DAILY.strip()},
x AS (SELECT concat(symbol, CAST(date AS VARCHAR)) AS id, {LABEL} AS y,
  {", ".join(f"coalesce({f}, 0e0) AS {f}" for f in IMPORTANCE)} FROM daily WHERE {LABEL} IS NOT NULL),
base AS (SELECT {_median_loss(list(IMPORTANCE))} + 1e-9 AS base FROM x),
p AS (SELECT x.*, pair, [{", ".join(IMPORTANCE)}][pair // 5 + 1] AS chosen FROM x, range(0, {5 * len(IMPORTANCE)}) r(pair)),
own AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY substring(md5(id), 1, 15), id) AS k FROM p),
mix AS (SELECT pair, chosen AS mixed,
  row_number() OVER (PARTITION BY pair ORDER BY substring(md5(concat('0|', pair, '|', id)), 1, 15), id) AS k FROM p),
l AS (SELECT pair, {_median_loss([f"CASE WHEN pair // 5 = {i} THEN mixed ELSE {f} END" for i, f in enumerate(IMPORTANCE)])} AS loss
  FROM own JOIN mix USING (pair, k) GROUP BY pair),
r AS (SELECT [{", ".join(f"'{f}'" for f in IMPORTANCE)}][pair // 5 + 1] AS feature, avg(loss - base) AS delta_pinball, max(base) AS base
  FROM l, base GROUP BY 1),
s AS (SELECT feature, delta_pinball, delta_pinball / base AS relative FROM r)
SELECT feature, {rounded_sql({"delta_pinball": 8, "relative": 6})} FROM s"""))
def permutation_importance(spark, sf_dir):
    from tidemark.functions.numeric import d

    rows = daily(spark, sf_dir).where(F.col(LABEL).isNotNull()).withColumn(
        "row_id", F.concat("symbol", F.col("date").cast("string")))
    score = lambda x: sum((d(w) * x[f] for f, w in IMPORTANCE.items()), d(0))
    out = drift.permutation_importance(rows, FEATURES, LABEL, score, "row_id")
    return rounded(out, {"delta_pinball": 8, "relative": 6})


@query("promotion", with_views(["prices_d"], f"""{DAILY.strip()},
h AS (SELECT symbol, date >= DATE '{SPLIT}' AS recent, avg(logret_1d) / stddev_pop(logret_1d) * sqrt(252e0) AS s
      FROM daily GROUP BY ALL),
c AS (SELECT symbol AS horizon, s AS c_nw, abs(s) / 2 AS lo FROM h WHERE recent),
g AS (SELECT symbol AS horizon, s AS r_nw, symbol <> 'SLV' AS has_metrics FROM h WHERE NOT recent AND symbol <> 'GC=F')
SELECT horizon, CASE WHEN r_nw IS NULL OR NOT has_metrics THEN lo > -0.25 AND c_nw > -0.10
  ELSE lo > 0 AND c_nw > r_nw + 0.05 END AS promoted, round(c_nw, 6) AS conservative_sharpe FROM c LEFT JOIN g USING (horizon)"""))
def promotion(spark, sf_dir):
    cut = F.lit(SPLIT).cast("date")
    halves = daily(spark, sf_dir).groupBy(F.col("symbol").alias("horizon"), (F.col("date") >= cut).alias("recent")).agg(
        metrics.sharpe(F.col("logret_1d")).alias("sharpe_nw"))
    none = F.lit(None).cast("double")

    def entry(df, known):
        return df.select("horizon", F.concat(F.lit("models/"), "horizon").alias("path"), known.alias("has_metrics"),
                         none.alias("sharpe_nonoverlap"), "sharpe_nw", none.alias("sharpe_med"),
                         (F.abs("sharpe_nw") / 2).alias("sharpe_lo"))

    new = entry(halves.where("recent"), F.lit(True))
    old = entry(halves.where((~F.col("recent")) & (F.col("horizon") != "GC=F")), F.col("horizon") != "SLV")
    return rounded(S.promote(new, old).drop("path"), {"conservative_sharpe": 6})


@query("training_matrix", with_views(["prices_d"], f"""{DAILY.strip()}
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql({LABEL: 6})},
  round(coalesce(logret_20d, 0e0), 6) + 0e0 AS logret_20d, round(coalesce(yz_20, 0e0), 6) AS yz_20
FROM daily WHERE {LABEL} IS NOT NULL"""))
def training_matrix(spark, sf_dir):
    out = P.training_rows(daily(spark, sf_dir), ["logret_20d", "yz_20"], LABEL)
    return dated(rounded(out.select("date", "symbol", LABEL, "logret_20d", "yz_20"),
                         {LABEL: 6, "logret_20d": 6, "yz_20": 6}))


@query("price_band", with_views(["prices_d"], f"""{DAILY.strip()},
b AS (SELECT date, symbol, list_sort(list_transform([-0.2e0, 0.1e0, -0.05e0, 0.3e0, 0e0],
        lambda q: close * exp(coalesce(logret_5d, 0e0) + q))) AS p, close FROM daily),
r AS (SELECT date, symbol, p[1] AS p10, p[3] AS p50, p[5] AS p90 FROM b)
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql({"p10": 3, "p50": 3, "p90": 3})} FROM r"""))
def price_band(spark, sf_dir):
    residuals = F.array(*[F.lit(x) for x in (-0.2, 0.1, -0.05, 0.3, 0.0)])
    band = calibrate.price_band(F.col("close"), F.coalesce("logret_5d", F.lit(0.0)), residuals)
    out = daily(spark, sf_dir).withColumn("p", band).select(
        "date", "symbol", *[F.get("p", i).alias(n) for i, n in ((0, "p10"), (2, "p50"), (4, "p90"))])
    return dated(rounded(out, {"p10": 3, "p50": 3, "p90": 3}))


@query("monotone_quantiles", with_views(["prices_d"], f"""{DAILY.strip()},
r AS (SELECT date, symbol, greatest(logret_1d, logret_5d) AS m2, greatest(logret_1d, logret_5d, logret_20d) AS m3
      FROM daily WHERE logret_20d IS NOT NULL)
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql({"m2": 6, "m3": 6})} FROM r"""))
def monotone_quantiles(spark, sf_dir):
    rows = daily(spark, sf_dir).where(F.col("logret_20d").isNotNull())
    m = calibrate.monotone(F.array("logret_1d", "logret_5d", "logret_20d"))
    out = rows.withColumn("m", m).select("date", "symbol", F.get("m", 1).alias("m2"), F.get("m", 2).alias("m3"))
    return dated(rounded(out, {"m2": 6, "m3": 6}))
