"""Queries that write and read back: lake scan, cache, index, predictions; and those that call a user's functions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import ORACLES, query, rounded, rounded_sql, with_views
from tidemark.catalog import feeds, similar  # noqa: F401  their SQL is compared with
from tidemark.catalog.daily import dated, stored_panel
from tidemark.catalog.evaluation import LABEL, ROWS, WALK, daily
from tidemark.catalog.streams import new_folder
from tidemark.operators import backtest as B
from tidemark.operators import normalize
from tidemark.operators import similarity as S
from tidemark.operators.robust import fit_scaler
from tidemark.plans import news as N
from tidemark.plans import settle
from tidemark.sources import lake as L


def lake_of(spark) -> L.Lake:
    return L.Lake(spark, new_folder(spark, "lake"))


@query("lake_scan", with_views(["prices_d"], """
SELECT CAST(date AS VARCHAR) AS date, symbol, close FROM prices_d WHERE date >= DATE '1995-07-01'"""))
def lake_scan(spark, sf_dir):
    """A date bound and three columns of a stored table."""
    lake = lake_of(spark)
    lake.upsert("prices_d", views.prices_d(spark, sf_dir))
    return dated(lake.read("prices_d", "1995-07-01", ["date", "symbol", "close"]))


@query("lake_cached", with_views(["prices_d"], """
SELECT symbol, count(*) AS n, max(close) AS highest FROM prices_d GROUP BY symbol"""))
def lake_cached(spark, sf_dir):
    """The second call finds the stored result and doesn't build."""
    lake, prices = lake_of(spark), views.prices_d(spark, sf_dir)
    key = L.fingerprint({"prices_d": (prices, "date")}).first().fingerprint
    lake.cached("highest", key, lambda: prices.groupBy("symbol").agg(F.count("*").alias("n"), F.max("close").alias("highest")))
    return lake.cached("highest", key, lambda: prices.limit(0))


@query("analogue_index_stored", ORACLES["analogue_index"])
def analogue_index_stored(spark, sf_dir):
    """The index and its scaler written, read back and used to scale the days again."""
    panel, path = stored_panel(spark, sf_dir), new_folder(spark, "index")
    rows = S.indexable(panel, similar.FEATURES, "target_logret_20d")
    scaler = fit_scaler(rows, similar.FEATURES)
    S.write_index(S.build_index(panel, similar.FEATURES, "target_logret_20d", scaler), scaler, path)
    index, scaler = S.read_index(spark, path)
    again = S.build_index(panel, similar.FEATURES, "target_logret_20d", scaler).select("date", F.col("vector").alias("again"))
    same = index.join(again, "date").where(F.forall(F.zip_with("vector", "again", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x))
    out = same.select("date", *[F.get("vector", i).alias(name) for i, name in enumerate(similar.ENTRIES)])
    return dated(rounded(out, similar.ENTRIES))


QUANTILES = {"q10": -1.25, "q25": -0.5, "q50": 0.0, "q75": 0.5, "q90": 1.25}


@query("prediction_writer", with_views(["prices_d"], f"""
r AS (SELECT date, close AS ref_price, (floor(close) % 41 - 20) / 1e3 AS mu, (floor(close) % 7 + 1) / 1e2 AS sigma
      FROM prices_d WHERE symbol = 'GC=F')
SELECT CAST(date AS VARCHAR) AS date, 16 AS hour, 'm1' AS model_version, 20 AS horizon_d, ref_price,
  {", ".join(f"round(mu + {z}e0 * sigma, 6) AS {q}" for q, z in QUANTILES.items())}, round(mu, 6) AS context_mu FROM r"""))
def prediction_writer(spark, sf_dir):
    """Scored days to stored predictions; a dry run before stores none."""
    p = views.prices_d(spark, sf_dir).where(F.col("symbol") == "GC=F")
    mu, sigma = (F.floor("close") % 41 - 20) / 1000.0, (F.floor("close") % 7 + 1) / 100.0
    scored = p.select("date", F.col("close").alias("gold_close"), mu.alias("mu"), sigma.alias("sigma")).withColumns({
        "log_var": F.log(F.col("sigma")) * 2.0, "conformal_scale": F.lit(1.0), "confidence": F.lit(0.5),
        **{q: F.col("mu") + z * F.col("sigma") for q, z in QUANTILES.items()}})
    lake = lake_of(spark)
    rows = settle.prediction_rows(scored, "m1", 20)
    settle.write_predictions(lake, rows, dry_run=True)
    settle.write_predictions(lake, rows)
    out = lake.read("predictions").select(
        F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "model_version", "horizon_d", "ref_price", *QUANTILES,
        F.get_json_object("context_json", "$.mu").cast("double").alias("context_mu"))
    return dated(rounded(out, {**{q: 6 for q in QUANTILES}, "context_mu": 6}))


@query("event_price_kind", """
SELECT event_id, CASE WHEN value > 20 THEN value WHEN user_id % 3 <> 0 THEN value * 2 END AS price,
  event_type = 'click' AS is_market, event_type IN ('view', 'signup') AS is_text FROM events""")
def event_price_kind(spark, sf_dir):
    """The middle price, or the close where that is zero; which events are market and which are text."""
    e = feeds.raw_events(spark, sf_dir).select("event_id", "type").join(feeds.events(spark, sf_dir), "event_id").withColumns({
        "mid": F.when(F.col("value") > 20, F.col("value")).otherwise(F.lit(0.0)),
        "close": F.when(F.col("user_id") % 3 != 0, F.col("value") * 2)})
    return e.select("event_id", normalize.price(e).alias("price"), normalize.is_market(F.col("type")).alias("is_market"),
                    normalize.is_text(F.col("type")).alias("is_text"))


def least_squares(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    """A line through the training days."""
    slope, intercept = np.polyfit(x[:, 0], y, 1)
    return new[:, 0] * slope + intercept


@query("backtest_fitted", with_views(["prices_d"], f"""{ROWS.strip()},
x AS (SELECT *, coalesce(logret_20d, 0e0) AS x FROM num),
fit AS (SELECT f.symbol, f.fold, regr_slope({LABEL}, x) AS slope, regr_intercept({LABEL}, x) AS intercept FROM fold f
  JOIN x ON x.symbol = f.symbol AND x.i < f.train_end GROUP BY ALL),
r AS (SELECT x.symbol, date, f.fold, x * slope + intercept AS fitted FROM x
  JOIN fold f ON x.symbol = f.symbol AND i >= test_start AND i < test_end JOIN fit ON fit.symbol = f.symbol AND fit.fold = f.fold)
SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(fold AS BIGINT) AS fold, {rounded_sql({"fitted": 6})} FROM r"""))
def backtest_fitted(spark, sf_dir):
    """A user's fit-and-predict function, run once per series and fold."""
    out = B.run(daily(spark, sf_dir), LABEL, WALK, ["symbol"], B.per_fold(least_squares, ["logret_20d"], LABEL, ["symbol"]))
    out = out.select("symbol", "date", "fold", F.col("pred").alias("fitted"))
    return dated(rounded(out, {"fitted": 6}))


def reply_of(body: str) -> str | None:
    """A stand-in for an extraction backend: it answers with figures of the text, and not at all to short ones."""
    if len(body) < 40:
        return None
    return "```json\n" + json.dumps({"event_type": f"words{body.count(' ') % 7}", "horizon_minutes": len(body),
                                     "confidence": len(body) % 100 / 100, "novel": len(body) % 2 == 0}) + "\n```"


@query("news_extracted", with_views(["news"], """
b AS (SELECT id, concat(coalesce(title, ''), ' ', coalesce(text, '')) AS body FROM news)
SELECT id AS news_id, concat('words', (length(body) - length(replace(body, ' ', ''))) % 7) AS event_type,
  CAST(greatest(5, least(10080, length(body))) AS INTEGER) AS horizon_minutes, round(length(body) % 100 / 1e2, 2) AS confidence,
  length(body) % 2 = 0 AS novel FROM b WHERE length(body) >= 40"""))
def news_extracted(spark, sf_dir):
    """A user's extraction function over all pending headlines, its replies made rows."""
    none = spark.createDataFrame([], "news_id string, model_version string")
    replies = N.extract(N.pending(views.news(spark, sf_dir), none, "v1"), reply_of)
    return N.coerce_features(replies, "v1").select("news_id", "event_type", "horizon_minutes",
                                                   F.round("confidence", 2).alias("confidence"), "novel")


def lengths_of(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("news_embedded", with_views(["news"], """
SELECT id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks
FROM news"""))
def news_embedded(spark, sf_dir):
    """A user's embedding function over whole texts."""
    e = N.embed(views.news(spark, sf_dir), lengths_of, text="text")
    return e.select("id", F.get("topic_embedding", 0).cast("double").alias("chars"),
                    F.get("topic_embedding", 1).cast("double").alias("blanks"))
