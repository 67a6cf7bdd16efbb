"""Macro queries: surprise, changed observations, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views
from tidemark.catalog.daily import dated
from tidemark.operators import macro, normalize
from tidemark.sources import feeds


@query("macro_surprise", with_views(["macro_d"], f"""
r AS (SELECT date, series_id, value, CASE WHEN count(value) OVER w >= 2
   THEN (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) END AS surprise FROM macro_d
   WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT CAST(date AS VARCHAR) AS date, series_id, {rounded_sql({"surprise": 5})} FROM r"""))
def macro_surprise(spark, sf_dir):
    out = macro.surprise(views.macro_d(spark, sf_dir))
    return dated(rounded(out.select("date", "series_id", "surprise"), {"surprise": 5}))


@query("macro_surprise_given", with_views(["macro_d"], f"""
g AS (SELECT *, CASE WHEN value > 6 THEN value - 6 END AS given FROM macro_d),
h AS (SELECT date, series_id, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS z,
        count(value) OVER w AS k FROM g WHERE given IS NULL
   WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
r AS (SELECT g.date, g.series_id, coalesce(given, CASE WHEN k >= 2 THEN z END) AS surprise
   FROM g LEFT JOIN h ON g.date = h.date AND g.series_id = h.series_id)
SELECT CAST(date AS VARCHAR) AS date, series_id, {rounded_sql({"surprise": 5})} FROM r"""))
def macro_surprise_given(spark, sf_dir):
    m = views.macro_d(spark, sf_dir).withColumn("given", F.when(F.col("value") > 6, F.col("value") - 6))
    out = macro.surprise(m, given="given")
    return dated(rounded(out.select("date", "series_id", "surprise"), {"surprise": 5}))


@query("macro_change_only", with_views(["macro_d"], """
m AS (SELECT date, series_id, round(value, 0) AS value FROM macro_d),
r AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS prev FROM m)
SELECT CAST(date AS VARCHAR) AS date, series_id, value FROM r WHERE prev IS NULL OR prev <> value"""))
def macro_change_only(spark, sf_dir):
    m = views.macro_d(spark, sf_dir).withColumn("value", F.round("value", 0))
    return dated(feeds.changed_observations(m))


@query("macro_newest", with_views(["macro_d"], """
SELECT series_id, CAST(max(date) AS VARCHAR) AS date, arg_max(value, date) AS value,
  CASE WHEN series_id IN ('FEDFUNDS', 'CPIAUCSL', 'UNRATE', 'GDP', 'T10YIE') THEN 'high' ELSE 'medium' END AS impact
FROM macro_d GROUP BY series_id"""))
def macro_newest(spark, sf_dir):
    return dated(feeds.newest_observation(views.macro_d(spark, sf_dir)))


@query("macro_vector", with_views(["macro_d"], f"""
r AS (SELECT date, series_id, CASE WHEN count(value) OVER w >= 2
   THEN (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) ELSE 0e0 END AS surprise FROM macro_d
   WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
v AS (SELECT date, series_id, surprise,
  CASE series_id WHEN 'FEDFUNDS' THEN 1 WHEN 'DGS10' THEN 4 WHEN 'DGS2' THEN 5 WHEN 'VIXCLS' THEN 7
                 WHEN 'T10YIE' THEN 11 ELSE 12 END AS hot,
  CASE series_id WHEN 'FEDFUNDS' THEN 1e0 WHEN 'DGS10' THEN 0.9e0 WHEN 'DGS2' THEN 0.8e0 WHEN 'VIXCLS' THEN 0.85e0
                 WHEN 'T10YIE' THEN 0.9e0 ELSE 0.4e0 END AS impact FROM r)
SELECT CAST(date AS VARCHAR) AS date, series_id, CAST(hot AS INTEGER) AS hot, impact, CAST(14 AS INTEGER) AS width,
  {rounded_sql({"surprise": 5})} FROM v"""))
def macro_vector(spark, sf_dir):
    out = normalize.series_category(macro.surprise(views.macro_d(spark, sf_dir)))
    out = out.withColumn("v", normalize.macro_vector())
    out = out.select("date", "series_id", F.array_position("v", 1.0).cast("int").alias("hot"),
                     F.get("v", 12).alias("impact"), F.size("v").alias("width"), F.get("v", 13).alias("surprise"))
    return dated(rounded(out, {"surprise": 5}))


@query("series_nodes", with_views(["macro_d"], """
SELECT series_id, CASE WHEN series_id IN ('DGS10', 'DGS2') THEN 'YIELDS' WHEN series_id = 'VIXCLS' THEN 'VIX'
  WHEN series_id = 'FEDFUNDS' THEN 'FED' WHEN series_id = 'T10YIE' THEN 'INFLATION' END AS node, count(*) AS n
FROM macro_d GROUP BY 1, 2"""))
def series_nodes(spark, sf_dir):
    m = views.macro_d(spark, sf_dir)
    return m.groupBy("series_id", normalize.causal_node(F.col("series_id")).alias("node")).agg(F.count("*").alias("n"))
