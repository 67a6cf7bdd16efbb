"""Model queries: fits, scoring, error model, dossier, packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views
from tidemark.catalog.daily import dated, panel_digits, panel_sql, stored_panel
from tidemark.catalog.evaluation import DAILY, LABEL, _mixed_sql, daily
from tidemark.catalog.scans import filter_sql
from tidemark.functions.numeric import pinball
from tidemark.functions.vectors import linear_score
from tidemark.operators import robust, scans
from tidemark.operators.blocks import Order
from tidemark.plans import dossier as D
from tidemark.plans import news as N
from tidemark.plans import training as M
from tidemark.plans.analogues import analogues_of
from tidemark.plans.panel import latest_panel_row, select_features

_PRIOR = " + ".join(f"{w}e0 * coalesce({f}, 0e0)" for f, w in M.STRUCT_PRIOR.items())


@query("structural_score", panel_sql(f""",
r AS (SELECT date, {_PRIOR} AS mu_struct FROM panel)
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql({"mu_struct": 6})} FROM r"""))
def structural_score(spark, sf_dir):
    p = stored_panel(spark, sf_dir)
    return dated(rounded(p.select("date", linear_score(M.STRUCT_PRIOR).alias("mu_struct")), {"mu_struct": 6}))


@query("chronological_split", with_views(["prices_d"], f"""{DAILY.strip()},
n AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k,
        count(*) OVER (PARTITION BY symbol) AS n FROM daily WHERE {LABEL} IS NOT NULL)
SELECT symbol, CAST(date AS VARCHAR) AS date, k > greatest(1, floor(n * 0.85e0)) AS is_val FROM n"""))
def chronological_split(spark, sf_dir):
    rows = daily(spark, sf_dir).where(F.col(LABEL).isNotNull()).select("symbol", "date")
    return dated(M.chronological_split(rows, ["symbol"]))


def _selection_sql() -> str:
    names = [c for c in panel_digits() if c != "gold_close" and not c.startswith("target_")]
    forced = ", ".join(f"'{c}'" for c in M.STRUCT_PRIOR)
    counts = ", ".join(f"count({c}) / CAST(count(*) AS DOUBLE)" for c in names)
    quoted = ", ".join(f"'{c}'" for c in names)
    return panel_sql(f""",
c AS (SELECT unnest([{quoted}]) AS feature, unnest([{counts}]) AS coverage FROM panel),
o AS (SELECT *, CASE WHEN feature IN ({forced}) THEN list_position([{forced}], feature) ELSE 100 END AS pref FROM c),
r AS (SELECT feature, coverage, CAST(row_number() OVER (ORDER BY pref, coverage DESC, feature) - 1 AS INTEGER) AS position FROM o)
SELECT position, feature, round(coverage, 6) AS coverage FROM r WHERE position < 32""")


@query("selected_features", _selection_sql())
def selected_features(spark, sf_dir):
    p = stored_panel(spark, sf_dir)
    names = select_features(p, list(M.STRUCT_PRIOR), 32)
    coverage = p.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in names])
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("coverage"))
                        for i, c in enumerate(names)])
    return rounded(coverage.select(F.explode(entries).alias("e")).select("e.*"), {"coverage": 6})


@query("quantile_fit")
def quantile_fit(spark, sf_dir):
    """Five quantiles of the 20-day return on two lagged returns, pooled over symbols."""
    names = ["logret_5d", "logret_20d"]
    fit = M.fit_quantiles(daily(spark, sf_dir), names, LABEL)
    rows = [(float(t), *[float(v) for v in w]) for t, w in fit.items()]
    return rounded(spark.createDataFrame(rows, "tau double, logret_5d double, logret_20d double, intercept double"),
                   {"logret_5d": 4, "logret_20d": 4, "intercept": 4})


GROUPS = ["GC=F", "SLV", "DX-Y.NYB", "^VIX"]
_GROUP = f"CASE WHEN symbol IN ({', '.join(repr(g) for g in GROUPS)}) THEN symbol ELSE '' END"


@query("quantile_fit_loss", with_views(["prices_d"], f"""{DAILY.strip()},
y AS (SELECT {_GROUP} AS g, {LABEL} AS y FROM daily WHERE {LABEL} IS NOT NULL),
q AS (SELECT g, quantile_disc(y, 0.1) AS q10, quantile_disc(y, 0.25) AS q25, quantile_disc(y, 0.5) AS q50,
  quantile_disc(y, 0.75) AS q75, quantile_disc(y, 0.9) AS q90 FROM y GROUP BY g),
e AS (SELECT unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) AS tau, unnest([y - q10, y - q25, y - q50, y - q75, y - q90]) AS e
  FROM y JOIN q USING (g))
SELECT tau, round(avg(greatest(tau * e, (tau - 1) * e)), 3) AS loss FROM e GROUP BY tau"""))
def quantile_fit_loss(spark, sf_dir):
    """A column per symbol group makes the best fit known: its loss is that of the groups' own quantiles."""
    names = [f"g{i}" for i in range(len(GROUPS))]
    rows = daily(spark, sf_dir).where(F.col(LABEL).isNotNull()).withColumns(
        {n: (F.col("symbol") == g).cast("double") for n, g in zip(names, GROUPS)})
    fit = M.fit_quantiles(rows, names, LABEL)
    losses = F.array(*[F.struct(F.lit(float(t)).alias("tau"), pinball(
        F.col(LABEL), linear_score(dict(zip(names, w.tolist())), float(w[-1])), t).alias("loss")) for t, w in fit.items()])
    out = rows.select(F.explode(losses).alias("e")).groupBy("e.tau").agg(F.avg("e.loss").alias("loss"))
    return rounded(out, {"loss": 3})


FITTED = ["logret_5d", "logret_20d"]
_SUMS = {c: f"sum(abs(coalesce({c}, 0e0)))" for c in FITTED} | {"intercept": "count(*) * 1e0"}


@query("quantile_fit_balance", with_views(["prices_d"], f"""{DAILY.strip()},
s AS (SELECT unnest([{", ".join(f"'{c}'" for c in _SUMS)}]) AS feature, unnest([{", ".join(_SUMS.values())}]) AS weight
  FROM daily WHERE {LABEL} IS NOT NULL)
SELECT tau, feature, round(weight, 4) AS weight, true AS balanced
FROM s, (SELECT unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) AS tau)"""))
def quantile_fit_balance(spark, sf_dir):
    """What makes a quantile fit the best one: for each feature its sum over the rows below the fit is tau of the whole sum.

    `balanced` allows a hundredth of the feature's absolute sum, since rows at the fit count as neither.
    """
    rows = daily(spark, sf_dir).where(F.col(LABEL).isNotNull()).select(F.col(LABEL).alias("y"), *[
        F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FITTED], F.lit(1.0).alias("intercept"))
    fit = M.fit_quantiles(rows, FITTED, "y")
    entries = []
    for tau, w in fit.items():
        below = (F.col("y") < linear_score(dict(zip(FITTED, w.tolist())), float(w[-1]))).cast("double")
        entries += [F.struct(F.lit(float(tau)).alias("tau"), F.lit(c).alias("feature"), F.col(c).alias("x"),
                             (F.col(c) * (below - F.lit(float(tau)))).alias("pull")) for c in _SUMS]
    sums = rows.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.tau", "e.feature").agg(
        F.sum(F.abs("e.x")).alias("weight"), F.sum("e.pull").alias("pull"))
    return rounded(sums.select("tau", "feature", "weight", (F.abs("pull") <= 0.01 * F.col("weight")).alias("balanced")),
                   {"weight": 4})


GIVEN = ["logret_5d", "logret_20d", "yz_20"]
_EACH = lambda template: ", ".join(template.format(c=c) for c in GIVEN)
SCORES = {c: 6 for c in ("mu", "sigma", "q10", "q25", "q50", "q75", "q90", "confidence")}


@query("forecast_given", with_views(["prices_d"], f"""{DAILY.strip()},
w AS (SELECT {_EACH("quantile_cont(coalesce({c}, 0e0), 0.005) AS lo_{c}, quantile_cont(coalesce({c}, 0e0), 0.995) AS hi_{c}")} FROM daily),
c AS (SELECT date, symbol, {_EACH("greatest(least(coalesce({c}, 0e0), greatest(hi_{c}, lo_{c} + 1e-6)), lo_{c}) AS {c}")} FROM daily, w),
m AS (SELECT {_EACH("median({c}) AS m_{c}")} FROM c),
s AS (SELECT {_EACH("1.4826e0 * median(abs({c} - m_{c})) AS s_{c}")} FROM c, m),
z AS (SELECT date, symbol, {_EACH("greatest(-8e0, least(8e0, ({c} - m_{c}) / CASE WHEN s_{c} < 1e-8 THEN 1e0 ELSE s_{c} END)) AS {c}")}
  FROM c, m, s),
p AS (SELECT date, symbol, 0.001e0 + 0.004e0 * logret_5d - 0.003e0 * logret_20d + 0.5e0 * (0.002e0 * yz_20 - 0.001e0 * logret_5d) AS mu,
  -7e0 + 0.3e0 * yz_20 AS log_var FROM z),
g AS (SELECT *, greatest(1e-6, least(0.5e0, exp(0.5e0 * log_var))) AS sigma FROM p),
r AS (SELECT date, symbol, mu, sigma, mu - 1.2e0 * 1.2816e0 * sigma AS q10, mu - 1.2e0 * 0.6745e0 * sigma AS q25, mu AS q50,
  mu + 1.2e0 * 0.6745e0 * sigma AS q75, mu + 1.2e0 * 1.2816e0 * sigma AS q90,
  greatest(0.05e0, least(0.99e0, exp(-0.5e0 * log_var))) AS confidence FROM g)
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql(SCORES)} FROM r"""))
def forecast_given(spark, sf_dir):
    """Scores of a forecaster whose weights are given instead of learned: scaling, parts, bands, confidence."""
    from pyspark.ml.feature import SQLTransformer

    rows = daily(spark, sf_dir).select("date", "symbol", *GIVEN)
    winsor = robust.fit_winsor(rows, GIVEN)
    scaler = robust.fit_scaler(robust.apply_winsor(rows, GIVEN, winsor), GIVEN)
    part = lambda e: SQLTransformer(statement=f"SELECT *, {e} AS prediction FROM __THIS__")
    model = M.Forecaster(GIVEN, {"logret_5d": 0.004, "logret_20d": -0.003}, 0.001, winsor, scaler,
                         part("0.002D * yz_20 - 0.001D * logret_5d"), part("-7.0D + 0.3D * yz_20"), 0.5, 1.2)
    return dated(rounded(model.score(rows, ("date", "symbol")).select("date", "symbol", *SCORES), SCORES))


def error_rows(spark, sf_dir):
    """Absolute errors of the naive forecast per symbol and day, with their context and regime."""
    rows = daily(spark, sf_dir).where(F.col(LABEL).isNotNull()).select(
        "symbol", "date", F.array("logret_1d", "logret_5d", "logret_20d", "yz_20").alias("context"),
        F.when(F.abs("logret_20d") > 0.5, "TRENDING").otherwise("RANGING").alias("regime"),
        F.abs(F.col(LABEL)).alias("abs_error"))
    return rows.withColumn("context", F.transform("context", lambda x: F.coalesce(x, F.lit(0.0))))


@query("error_model_given", with_views(["prices_d"], f"""{DAILY.strip()},
e AS (SELECT symbol, date, abs({LABEL}) AS err, 0.01e0 + 0.5e0 * abs(coalesce(logret_5d, 0e0)) + 0.1e0 * coalesce(yz_20, 0e0) AS p
  FROM daily WHERE {LABEL} IS NOT NULL),
c AS (SELECT symbol, date, greatest(0.05e0, least(0.99e0, 1 / (1 + exp(p / greatest(sd, 1e-9) - 1.5e0)))) AS raw
  FROM e, (SELECT stddev_samp(err) AS sd FROM e)),
l AS (SELECT symbol, list(raw ORDER BY date) AS x, list(date ORDER BY date) AS ids FROM c GROUP BY symbol),
{filter_sql("l", "0.001e0", "0.05e0", "0.1e0", "0.55e0")},
r AS (SELECT symbol, CAST(ids[i] AS VARCHAR) AS date, x[i] AS raw_confidence, greatest(0.1e0, least(0.99e0, s)) AS confidence
  FROM step JOIN l USING (symbol))
SELECT symbol, date, {rounded_sql({"raw_confidence": 6, "confidence": 6})} FROM r""", recursive=True))
def error_model_given(spark, sf_dir):
    """Predicted errors by a given formula, turned into confidence and smoothed by the filter."""
    from pyspark.ml.feature import SQLTransformer

    rows = error_rows(spark, sf_dir)
    model = SQLTransformer(statement="SELECT *, 0.01D + 0.5D * abs(context[1]) + 0.1D * context[3] AS prediction FROM __THIS__")
    raw = M.raw_confidence(rows, model, rows.agg(F.stddev_samp("abs_error")).first()[0] or 1e-3)
    out = scans.kalman_confidence(raw, "raw_confidence", Order(("symbol",), ("date",), F.year("date").cast("long")))
    return dated(rounded(out.select("symbol", "date", "raw_confidence", "confidence"), {"raw_confidence": 6, "confidence": 6}))


_MODEL: dict = {}


def forecaster(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODEL:
        p = stored_panel(spark, sf_dir)
        features = select_features(p, list(M.STRUCT_PRIOR), 64)
        _MODEL[key] = M.train(p, features, "target_logret_20d")
    return _MODEL[key]


@query("forecast_scores")
def forecast_scores(spark, sf_dir):
    """Train on the panel, then score every panel date."""
    out = forecaster(spark, sf_dir).score(stored_panel(spark, sf_dir))
    return dated(out.select("date", "mu", "sigma", "q10", "q25", "q50", "q75", "q90", "confidence"))


@query("replay_sample", with_views(["prices_d"], f"""{DAILY.strip()},
n AS (SELECT symbol, date, abs({LABEL}) AS abs_error, date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) + 3 * 7919 AS d,
        row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM daily WHERE {LABEL} IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_mixed_sql("d")}, date) AS pick FROM n WHERE k <= 120)
SELECT symbol, CAST(date AS VARCHAR) AS date, round(abs_error, 6) AS abs_error FROM s WHERE pick <= 40"""))
def replay_sample(spark, sf_dir):
    """Of each symbol's 120 newest errors a drawn 40; the draw is a hash of the day's number."""
    out = M.replay_sample(error_rows(spark, sf_dir), ["date"], ["symbol"], 40, 120, 3, F.unix_date("date"))
    return dated(rounded(out.select("symbol", "date", "abs_error"), {"abs_error": 6}))


@query("error_model_confidence")
def error_model_confidence(spark, sf_dir):
    """Learn absolute errors of the naive forecast per symbol-day, then turn predictions into confidence."""
    rows = error_rows(spark, sf_dir)
    sample = M.replay_sample(rows, ["date"], ["symbol"], draw=F.unix_date("date"))
    model = M.fit_error_model(sample)
    sd = rows.agg(F.stddev_samp("abs_error")).first()[0] or 1e-3
    out = M.raw_confidence(rows, model, sd)
    return dated(out.select("symbol", "date", "predicted_error", "raw_confidence"))


def _dossier(spark, sf_dir, past, regime=None):
    from tidemark.catalog.news import outcomes, predictions
    from tidemark.catalog.similar import ASOF
    from tidemark.plans.settle import recent_skill

    features = views.news_features(spark, sf_dir).withColumn("event_type", F.lit(None).cast("string"))
    top = N.top_headlines(views.news(spark, sf_dir), features, day="2024-01-02")
    skill = recent_skill(predictions(spark, sf_dir), outcomes(spark, sf_dir), 20, "1996-01-01")
    return D.build_dossier(latest_panel_row(stored_panel(spark, sf_dir), ASOF), top, past, skill, regime=regime)


@query("dossier")
def dossier(spark, sf_dir):
    from tidemark.catalog.similar import ASOF, FEATURES

    past = analogues_of(stored_panel(spark, sf_dir), FEATURES, "target_logret_20d", ASOF, k=8)
    out = D.dossier_text(_dossier(spark, sf_dir, past))
    return out.select(F.col("date").cast("string").alias("date"), "gold_close", "text")


def _dossier_sql() -> str:
    from tidemark.catalog.news import PREDICTIONS, SPLIT
    from tidemark.catalog.similar import ASOF, scaled_ctes

    return panel_sql(scaled_ctes() + f""",{PREDICTIONS},
hl AS (SELECT title, gold_impact, confidence, row_number() OVER (ORDER BY confidence * abs(gold_impact) DESC NULLS LAST, n.id) AS k
  FROM news n JOIN news_features f ON n.id = f.news_id WHERE CAST(n.ts AS DATE) = DATE '2024-01-02'),
tn AS (SELECT coalesce(string_agg(printf('  - [?] impact=%+.2f conf=%.2f: %s', gold_impact, confidence, title[1:140]), chr(10)
  ORDER BY k), '') AS top_news FROM hl WHERE k <= 8),
best AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, date) AS k FROM hits),
pa AS (SELECT coalesce(string_agg(printf('  - %s sim=%.2f → realised log-ret over horizon = %+.4f', CAST(date AS VARCHAR), similarity,
  target_logret), chr(10) ORDER BY k), '') AS analogues FROM best WHERE k <= 5),
sk AS (SELECT count(*) AS n, round(avg(CASE WHEN sign(realised_logret) = sign(q50) THEN 1 ELSE 0 END), 3) AS hit_rate,
  round(avg(pinball_loss), 5) AS mean_pinball_q50 FROM scored
  WHERE pred_date < DATE '{SPLIT}' AND settle_date + INTERVAL 16 HOUR >= TIMESTAMP '1996-01-01'),
last AS (SELECT * FROM panel WHERE date <= DATE '{ASOF}' ORDER BY date DESC LIMIT 1)
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql({c: 4 for c in D.SNAPSHOT})}, 'RANGING' AS regime, top_news, analogues, n, hit_rate,
  mean_pinball_q50 FROM last, tn, pa, sk""")


@query("dossier_parts", _dossier_sql())
def dossier_parts(spark, sf_dir):
    """The dossier's numbers, and the headlines and similar days as its text prints them."""
    from tidemark.catalog.similar import ASOF, FEATURES

    out = D.dossier_text(_dossier(spark, sf_dir, analogues_of(stored_panel(spark, sf_dir), FEATURES, "target_logret_20d", ASOF),
                                  scans.REGIMES[3]))
    part = lambda a, b: F.regexp_extract("text", f"(?s){a}\n(.*?)\n\n{b}", 1)
    return rounded(out.select(
        F.col("date").cast("string").alias("date"), *D.SNAPSHOT, F.regexp_extract("text", "REGIME: (.*)", 1).alias("regime"),
        part("TOP_NEWS_TODAY:", "HISTORICAL").alias("top_news"),
        part(r"HISTORICAL_ANALOGUES \(top-k similar regimes\):", "RECENT").alias("analogues"), "recent_skill.*"),
        {c: 4 for c in D.SNAPSHOT})


@query("thesis_rows", """
SELECT CAST(page_id AS VARCHAR) AS page, md5(url) AS thesis, CAST(page_id % 101 AS DOUBLE) / 1e2 AS confidence,
  concat('{"direction":"up","horizon_days":', page_id % 60, '}') AS predictions, '["a","b"]' AS falsifiable FROM pages""")
def thesis_rows(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    reply = F.to_json(F.struct(F.md5("url").alias("thesis"), (F.col("page_id") % 101 / 100.0).alias("confidence"),
                               F.lit("up").alias("direction"), (F.col("page_id") % 60).alias("horizon_days"),
                               F.array(F.lit("a"), F.lit("b")).alias("falsifiable")))
    rows = pages.select(F.col("page_id").cast("string").alias("date"), reply.alias("reply"))
    return D.thesis_rows(rows, "m1").select(F.col("date").alias("page"), "thesis", "confidence", "predictions", "falsifiable")


def packet_rows(t):
    """Ticks with a one-entry world state, a regime and a confidence."""
    return t.select(
        "event_id", "symbol", F.col("mid").alias("price"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.create_map(F.lit("level"), F.col("mid") / 7.0).alias("world_state"), (F.col("volume") / 97.0).alias("confidence"),
        F.when(F.col("volume") > 48, scans.REGIMES[0]).otherwise(scans.REGIMES[3]).alias("regime"))


def packet_values(out):
    packet = F.from_json("packet", "price double, world_state map<string,double>, confidence double, regime string")
    return out.select("event_id", "symbol", packet.alias("p")).select(
        "event_id", "symbol", F.round("p.price", 4).alias("price"), F.col("p.world_state")["level"].alias("level"),
        F.col("p.regime").alias("regime"), F.col("p.confidence").alias("confidence"))


@query("packets", with_views(["ticks"], """
SELECT event_id, symbol, round(mid, 4) AS price, round(mid / 7e0, 4) AS level,
  CASE WHEN volume > 48 THEN 'RISK-ON' ELSE 'RANGING' END AS regime, round(volume / 97e0, 4) AS confidence FROM ticks"""))
def packets(spark, sf_dir):
    """One JSON packet per tick, read back for the comparison."""
    from tidemark.streaming.sinks import packet_json

    return packet_values(packet_json(packet_rows(views.ticks(spark, sf_dir))))
