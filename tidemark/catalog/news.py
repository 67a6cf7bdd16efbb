"""News, settlement and lake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views, stripped
from tidemark.catalog.daily import NEWS_SQL, dated
from tidemark.plans import news as N
from tidemark.plans import settle as S
from tidemark.sources import lake

SIGNAL_DIGITS = {"impact_wmean": 6, "dispersion": 6}


@query("news_daily_signal", with_views(["news", "news_features"], f"""{NEWS_SQL.strip()}
SELECT CAST(date AS VARCHAR) AS date, intensity, {rounded_sql(SIGNAL_DIGITS)} FROM signal"""))
def news_daily_signal(spark, sf_dir):
    out = N.daily_signal(views.news(spark, sf_dir), views.news_features(spark, sf_dir))
    return dated(rounded(out, SIGNAL_DIGITS))


def two_versions(spark, sf_dir):
    """Features extracted again by a second model for the toxic half of the labels."""
    f = views.news_features(spark, sf_dir)
    again = views.table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select(
        F.concat(F.lit("n"), "doc_id").alias("news_id"))
    second = f.join(again, "news_id").withColumns({
        "model_version": F.lit("v2"), "gold_impact": -F.col("gold_impact")})
    return f.unionByName(second)


VERSIONS = """
f2 AS (SELECT * FROM news_features UNION ALL
  SELECT news_id, 'v2', -gold_impact, confidence, novel FROM news_features
  WHERE news_id IN (SELECT concat('n', doc_id) FROM labels WHERE toxic = 1))"""


def _versions_sql(chosen: str) -> str:
    return with_views(["news", "news_features"], f"""{VERSIONS.strip()},
{NEWS_SQL.strip().replace("news_features f", chosen + " f")}
SELECT CAST(date AS VARCHAR) AS date, intensity, {rounded_sql(SIGNAL_DIGITS)} FROM signal""")


@query("news_signal_latest_version", _versions_sql(
    "(SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY model_version DESC) = 1)"))
def news_signal_latest_version(spark, sf_dir):
    out = N.daily_signal(views.news(spark, sf_dir), two_versions(spark, sf_dir))
    return dated(rounded(out, SIGNAL_DIGITS))


@query("news_signal_all_versions", _versions_sql("f2"))
def news_signal_all_versions(spark, sf_dir):
    out = N.daily_signal(views.news(spark, sf_dir), two_versions(spark, sf_dir), latest_version_only=False)
    return dated(rounded(out, SIGNAL_DIGITS))


@query("news_topk", with_views(["news", "news_features"], f"""
j AS (SELECT CAST(n.ts AS DATE) AS date, n.id, n.title, confidence * abs(gold_impact) AS score
      FROM news n JOIN news_features f ON n.id = f.news_id),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, id) AS rank FROM j)
SELECT CAST(date AS VARCHAR) AS date, id, md5(title) AS title_md5, rank, {rounded_sql({"score": 6})}
FROM r WHERE rank <= 8"""))
def news_topk(spark, sf_dir):
    out = N.top_headlines(views.news(spark, sf_dir), views.news_features(spark, sf_dir))
    out = out.select("date", "id", F.md5("title").alias("title_md5"), F.col("rank").cast("long").alias("rank"), "score")
    return dated(rounded(out, {"score": 6}))


@query("news_pending", with_views(["news", "news_features"], """
SELECT n.id, md5(concat(coalesce(n.title, ''), ' ', coalesce(n.text, ''))) AS body_md5 FROM news n
LEFT JOIN news_features f ON f.news_id = n.id AND f.model_version = 'v1' WHERE f.news_id IS NULL"""))
def news_pending(spark, sf_dir):
    out = N.pending(views.news(spark, sf_dir), views.news_features(spark, sf_dir), "v1")
    return out.select("id", F.md5("body").alias("body_md5"))


@query("news_pending_newest", with_views(["news", "news_features"], """
SELECT n.id FROM news n LEFT JOIN news_features f ON f.news_id = n.id AND f.model_version = 'v1'
WHERE f.news_id IS NULL ORDER BY n.ts DESC, n.id LIMIT 100"""))
def news_pending_newest(spark, sf_dir):
    return N.pending(views.news(spark, sf_dir), views.news_features(spark, sf_dir), "v1", 100).select("id")


@query("feature_replies", """
SELECT concat('n', doc_id) AS news_id,
  CASE WHEN doc_id % 7 = 2 THEN 'other' ELSE substring(concat('type-', md5(source)), 1, 32) END AS event_type,
  CASE WHEN doc_id % 7 = 1 THEN 0e0 ELSE greatest(-1e0, least(1e0, (doc_id % 401 - 200) / 1e2)) END AS gold_impact,
  CAST(CASE WHEN doc_id % 5 = 0 THEN 60 ELSE greatest(5, least(10080, n_chars)) END AS INTEGER) AS horizon_minutes,
  doc_id % 2 = 0 AS novel, length(substring(source, 1, 240)) AS rationale_length
FROM documents WHERE lang <> 'es'""")
def feature_replies(spark, sf_dir):
    i = F.col("doc_id")
    body = F.to_json(F.struct(
        F.when(i % 7 != 2, F.concat(F.lit("type-"), F.md5("source"))).alias("event_type"),
        F.when(i % 7 == 1, "strong").otherwise(((i % 401 - 200) / 100.0).cast("string")).alias("gold_impact"),
        F.when(i % 5 != 0, F.col("n_chars")).alias("horizon_minutes"),
        (i % 2 == 0).alias("novel"), F.col("source").alias("rationale")))
    reply = (F.when(F.col("lang") == "es", "no object here").when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(i % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(body))
    docs = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("n"), i).alias("id"), reply.alias("reply"))
    out = N.coerce_features(docs, "v1")
    return out.select("news_id", "event_type", "gold_impact", "horizon_minutes", "novel",
                      F.length("rationale").cast("long").alias("rationale_length"))


SPLIT = "1998-01-01"

PREDICTIONS = """
predictions AS (SELECT concat('p', CAST(date AS STRING)) AS id, date AS pred_date, '20d@m1' AS model_version,
  20 AS horizon_d, close AS ref_price, (floor(close) % 41 - 20) / 1e3 AS q50 FROM prices_d WHERE symbol = 'GC=F'),
settled AS (SELECT p.id AS prediction_id, p.pred_date + 20 AS settle_date, arg_min(x.close, x.date) AS realised_price,
    any_value(ref_price) AS ref_price, any_value(q50) AS q50, any_value(pred_date) AS pred_date
  FROM predictions p JOIN prices_d x ON x.symbol = 'GC=F' AND x.date >= p.pred_date + 20 GROUP BY ALL),
scored AS (SELECT *, ln(realised_price / ref_price) AS realised_logret,
  greatest(0.5e0 * (ln(realised_price / ref_price) - q50), -0.5e0 * (ln(realised_price / ref_price) - q50)) AS pinball_loss
  FROM settled)"""


def predictions(spark, sf_dir):
    p = views.prices_d(spark, sf_dir).where(F.col("symbol") == "GC=F")
    return p.select(
        F.concat(F.lit("p"), F.col("date").cast("string")).alias("id"), F.col("date").alias("ts"),
        F.lit("20d@m1").alias("model_version"), F.lit(20).alias("horizon_d"), F.col("close").alias("ref_price"),
        ((F.floor("close") % 41 - 20) / 1000.0).alias("q50"))


def outcomes(spark, sf_dir):
    """Settlement of the predictions made before 1998; the others stay pending."""
    p = predictions(spark, sf_dir)
    none = spark.createDataFrame([], "prediction_id string")
    return S.settle(p.where(F.col("ts") < F.lit(SPLIT).cast("date")), none,
                    views.prices_d(spark, sf_dir), "2003-01-01")


@query("settle_predictions", with_views(["prices_d"], f"""{PREDICTIONS.strip()}
SELECT prediction_id, CAST(settle_date AS VARCHAR) AS settle_date, realised_price,
  {rounded_sql({"realised_logret": 6, "pinball_loss": 6})} FROM scored
WHERE pred_date >= DATE '{SPLIT}' AND settle_date <= DATE '2001-06-01'"""))
def settle_predictions(spark, sf_dir):
    done = predictions(spark, sf_dir).where(F.col("ts") < F.lit(SPLIT).cast("date")).select(
        F.col("id").alias("prediction_id"))
    out = S.settle(predictions(spark, sf_dir), done, views.prices_d(spark, sf_dir), "2001-06-01")
    out = out.withColumn("settle_date", F.to_date("settled_at")).drop("settled_at")
    return dated(rounded(out, {"realised_logret": 6, "pinball_loss": 6}), "settle_date")


@query("predictions_pending", with_views(["prices_d"], f"""{PREDICTIONS.strip()}
SELECT id, CAST(pred_date + 20 AS VARCHAR) AS settle_date FROM predictions
WHERE pred_date >= DATE '{SPLIT}' AND pred_date + 20 <= DATE '2001-06-01'"""))
def predictions_pending(spark, sf_dir):
    done = predictions(spark, sf_dir).where(F.col("ts") < F.lit(SPLIT).cast("date")).select(
        F.col("id").alias("prediction_id"))
    out = S.pending_predictions(predictions(spark, sf_dir), done, "2001-06-01")
    return dated(out.select("id", "settle_date"), "settle_date")


@query("recent_skill", with_views(["prices_d"], f"""{PREDICTIONS.strip()}
SELECT count(*) AS n, round(avg(CASE WHEN sign(realised_logret) = sign(q50) THEN 1 ELSE 0 END), 3) AS hit_rate,
  round(avg(pinball_loss), 5) AS mean_pinball_q50 FROM scored
WHERE pred_date < DATE '{SPLIT}' AND settle_date + INTERVAL 16 HOUR >= TIMESTAMP '1996-01-01'"""))
def recent_skill(spark, sf_dir):
    return S.recent_skill(predictions(spark, sf_dir), outcomes(spark, sf_dir), 20, "1996-01-01")


@query("upsert_prices", with_views(["prices_d"], """
b AS (SELECT date + 1 AS date, symbol, open, close * 2 AS close, volume AS seq FROM prices_d
      UNION ALL SELECT date, symbol, open, close * 3, 1e6 FROM prices_d WHERE volume > 2),
l AS (SELECT date, symbol, arg_max(open, seq) AS open, arg_max(close, seq) AS close FROM b GROUP BY ALL)
SELECT CAST(coalesce(l.date, t.date) AS VARCHAR) AS date, coalesce(l.symbol, t.symbol) AS symbol,
  CASE WHEN l.date IS NULL THEN t.open ELSE l.open END AS open, t.high,
  CASE WHEN l.date IS NULL THEN t.close ELSE l.close END AS close
FROM prices_d t FULL JOIN l ON l.date = t.date AND l.symbol = t.symbol"""))
def upsert_prices(spark, sf_dir):
    t = views.prices_d(spark, sf_dir).select("date", "symbol", "open", "high", "close")
    p = views.prices_d(spark, sf_dir)
    b = p.select(F.date_add("date", 1).alias("date"), "symbol", "open", (F.col("close") * 2).alias("close"),
                 F.col("volume").alias("seq")).unionByName(
        p.where("volume > 2").select("date", "symbol", "open", (F.col("close") * 3).alias("close"),
                                     F.lit(1e6).alias("seq")))
    return dated(lake.upsert_rows(t, b, ["date", "symbol"], "seq"))


@query("lake_row_counts", with_views(["prices_d", "macro_d", "cot_disagg", "news", "news_features"], """
SELECT * FROM (SELECT 'prices_d' AS "table", count(*) AS n FROM prices_d UNION ALL SELECT 'macro_d', count(*) FROM macro_d
UNION ALL SELECT 'cot_disagg', count(*) FROM cot_disagg UNION ALL SELECT 'news', count(*) FROM news
UNION ALL SELECT 'news_features', count(*) FROM news_features)"""))
def lake_row_counts(spark, sf_dir):
    names = ("prices_d", "macro_d", "cot_disagg", "news", "news_features")
    return lake.row_counts({n: getattr(views, n)(spark, sf_dir) for n in names})


@query("lake_runs", """
SELECT concat('run', conv_id) AS run_id, CAST(sum(length(text)) AS BIGINT) AS rows_added, max(role) AS source, count(*) AS records
FROM conversations GROUP BY 1""")
def lake_runs(spark, sf_dir):
    log = views.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("run"), "conv_id").alias("run_id"), F.col("role").alias("source"),
        F.length("text").alias("rows_added"), F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit("").alias("notes"))
    counts = log.groupBy("run_id").agg(F.count("*").alias("records"))
    return lake.run_report(log).join(counts, "run_id").select("run_id", "rows_added", "source", "records")


@query("lake_fingerprint", with_views(["prices_d", "macro_d", "cot_disagg", "etf_holdings", "news"], """
p AS (SELECT concat('prices_d:', count(*), ':', max(date)) AS part FROM prices_d UNION ALL
  SELECT concat('macro_d:', count(*), ':', max(date)) FROM macro_d UNION ALL
  SELECT concat('cot_disagg:', count(*), ':', max(report_date)) FROM cot_disagg UNION ALL
  SELECT concat('etf_flows:', count(*), ':', max(date)) FROM etf_holdings UNION ALL
  SELECT concat('news:', count(*), ':', max(ts)) FROM news)
SELECT substring(sha256(concat('GC=F|1995-01-01|', string_agg(part, '|' ORDER BY part))), 1, 16) AS fingerprint FROM p"""))
def lake_fingerprint(spark, sf_dir):
    v = lambda n: getattr(views, n)(spark, sf_dir)
    return lake.fingerprint({"prices_d": (v("prices_d"), "date"), "macro_d": (v("macro_d"), "date"),
                             "cot_disagg": (v("cot_disagg"), "report_date"), "etf_flows": (v("etf_holdings"), "date"),
                             "news": (v("news"), "ts")}, "GC=F", "1995-01-01")


def raw_news(spark, sf_dir):
    """Raw events of the news feed."""
    return views.news(spark, sf_dir).select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.lit("news").alias("type"),
        F.to_json(F.struct("url", "title", "text")).alias("payload"), "source", F.lit(1.0).alias("confidence"))


@query("news_sink_rows", with_views(["news"], f"""
SELECT substring(sha256(concat(url, '|', CAST(epoch_us(ts) // 1000000 AS VARCHAR))), 1, 32) AS id,
  source, {stripped("title")} AS title, md5({stripped("text")}) AS text_md5 FROM news
WHERE {stripped("title")} <> '' OR {stripped("text")} <> ''"""))
def news_sink_rows(spark, sf_dir):
    from tidemark.streaming.sinks import news_rows

    return news_rows(raw_news(spark, sf_dir)).select("id", "source", "title", F.md5("text").alias("text_md5"))
