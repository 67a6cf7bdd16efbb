"""Feed queries: messages are built by Spark from the supplied tables, then parsed and normalised."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views, stripped
from tidemark.operators import bars, normalize
from tidemark.sources import feeds, history


def seconds(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


SECONDS = "epoch_us({})/1e6"


def events(spark, sf_dir):
    return views.table(spark, sf_dir, "events")


def tick_lines(spark, sf_dir):
    """Quote-stream messages: errors become heartbeats, sign-ups lack a bid, views lack both sides."""
    kind = F.col("event_type")
    text = lambda c: c.cast("string")
    msg = F.to_json(F.struct(
        F.when(kind == "error", "heartbeat").otherwise("price").alias("event"), seconds().alias("timestamp"),
        F.concat(F.lit("S"), F.col("user_id") % 5).alias("symbol"), text(F.col("value")).alias("price"),
        F.when(~kind.isin("signup", "view"), text(F.col("value") - 0.25)).alias("bid"),
        F.when(kind != "view", text(F.col("value") + 0.5)).alias("ask"),
        F.when(kind != "click", F.col("event_id") % 97).alias("day_volume")))
    return events(spark, sf_dir).select("event_id", msg.alias("line"))


@query("feed_tick_messages", f"""
SELECT event_id, concat('S', user_id % 5) AS symbol, {rounded_sql({"mid": 4, "bid": 4, "ask": 4, "spread": 4})},
  volume, 'twelve_data' AS source, round(timestamp, 3) AS timestamp FROM (
  SELECT event_id, user_id, value AS mid,
    CASE WHEN event_type IN ('signup','view') THEN value ELSE value - 0.25e0 END AS bid,
    CASE WHEN event_type = 'view' THEN value ELSE value + 0.5e0 END AS ask,
    CASE WHEN event_type = 'view' THEN 0e0 ELSE value + 0.5e0 END
      - CASE WHEN event_type IN ('signup','view') THEN 0e0 ELSE value - 0.25e0 END AS spread,
    CASE WHEN event_type = 'click' THEN 0e0 ELSE CAST(event_id % 97 AS DOUBLE) END AS volume,
    {SECONDS.format("ts")} AS timestamp
  FROM events WHERE event_type <> 'error')""")
def feed_tick_messages(spark, sf_dir):
    out = feeds.tick_messages(tick_lines(spark, sf_dir)).select(
        "event_id", "payload.symbol", "payload.mid", "payload.bid", "payload.ask", "payload.spread",
        "payload.volume", "source", F.round("timestamp", 3).alias("timestamp"))
    return rounded(out, {"mid": 4, "bid": 4, "ask": 4, "spread": 4})


@query("feed_rate_quotes", f"""
SELECT event_id, 0.9e0 AS confidence, {rounded_sql({"mid": 4, "bid": 4, "ask": 4, "spread": 4})} FROM (
  SELECT event_id, value AS mid, CASE WHEN event_type = 'view' THEN value ELSE value - 0.25e0 END AS bid,
    value + 0.5e0 AS ask, value + 0.5e0 - CASE WHEN event_type = 'view' THEN value ELSE value - 0.25e0 END AS spread
  FROM events WHERE event_type <> 'error')""")
def feed_rate_quotes(spark, sf_dir):
    text = lambda c: c.cast("string")
    rate = F.struct(text(F.col("value")).alias("5. Exchange Rate"),
                    F.when(F.col("event_type") != "view", text(F.col("value") - 0.25)).alias("8. Bid Price"),
                    text(F.col("value") + 0.5).alias("9. Ask Price"))
    msg = F.to_json(F.struct(
        F.when(F.col("event_type") != "error", rate).alias("Realtime Currency Exchange Rate"),
        F.when(F.col("event_type") == "error", "call limit reached").alias("Note")))
    lines = events(spark, sf_dir).select("event_id", msg.alias("line"), seconds().alias("received_at"))
    out = feeds.rate_quotes(lines).select(
        "event_id", "confidence", "payload.mid", "payload.bid", "payload.ask", "payload.spread")
    return rounded(out, {"mid": 4, "bid": 4, "ask": 4, "spread": 4})


@query("feed_broker_prices", f"""
SELECT event_id, tradeable, {rounded_sql({"bid": 4, "ask": 4, "mid": 4, "spread": 4})} FROM (
  SELECT event_id, event_type <> 'click' AS tradeable, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread FROM (
    SELECT *, CASE WHEN event_type = 'view' THEN 0e0 ELSE value - 0.25e0 END AS bid, value + 0.5e0 AS ask
    FROM events WHERE event_type <> 'error'))""")
def feed_broker_prices(spark, sf_dir):
    kind = F.col("event_type")
    level = lambda c: F.struct(c.cast("string").alias("price"))
    msg = F.to_json(F.struct(
        F.when(kind == "error", "HEARTBEAT").otherwise("PRICE").alias("type"), seconds().cast("string").alias("time"),
        F.when(kind != "view", F.array(level(F.col("value") - 0.25), level(F.col("value") - 1))).alias("bids"),
        F.array(level(F.col("value") + 0.5)).alias("asks"),
        F.when(kind == "click", F.lit(False)).alias("tradeable")))
    out = feeds.broker_prices(events(spark, sf_dir).select("event_id", msg.alias("line"))).select(
        "event_id", "payload.tradeable", "payload.bid", "payload.ask", "payload.mid", "payload.spread")
    return rounded(out, {"bid": 4, "ask": 4, "mid": 4, "spread": 4})


def article_lines(spark, sf_dir):
    """One reply per 50 turns of a conversation, one article per turn; assistant turns have no description."""
    talk = views.table(spark, sf_dir, "conversations")
    article = F.struct(
        F.concat(F.lit(" "), "text").alias("title"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("description"),
        F.concat(F.lit("http://c/"), "conv_id", F.lit("/"), "turn").alias("url"),
        F.concat(F.lit("2024-03-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T12:00:"),
                 F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("+02:00")).alias("publishedAt"),
        F.struct(F.col("role").alias("name")).alias("source"))
    return talk.groupBy("conv_id", F.floor(F.col("turn") / 50)).agg(F.collect_list(article).alias("articles")).select(
        F.to_json(F.struct(F.lit("ok").alias("status"), "articles")).alias("line"))


@query("feed_news_articles", f"""
SELECT concat('http://c/', conv_id, '/', turn) AS url, {stripped("text")} AS title,
  CASE WHEN role = 'assistant' THEN '' ELSE {stripped("text")} END AS description,
  md5({stripped("concat(text, CASE WHEN role = 'assistant' THEN '' ELSE concat(' ', text) END)")}) AS text_md5,
  role AS source, epoch_us(TIMESTAMP '2024-03-01 10:00:00' + (conv_id % 28) * INTERVAL 1 DAY
    + (turn % 60) * INTERVAL 1 SECOND) / 1e6 AS timestamp
FROM conversations""")
def feed_news_articles(spark, sf_dir):
    return feeds.news_articles(article_lines(spark, sf_dir)).select(
        "payload.url", "payload.title", "payload.description", F.md5("payload.text").alias("text_md5"),
        "payload.source", "timestamp")


@query("feed_gdelt_articles", f"""
SELECT concat('http://x/', doc_id) AS url, {stripped("text")} AS title, md5({stripped("text")}) AS text_md5, source, lang AS language,
  epoch_us(TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 17 MINUTE) / 1e6 AS timestamp FROM documents""")
def feed_gdelt_articles(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").withColumn("ts", F.expr(
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '17' MINUTE"))
    article = F.struct(
        F.col("text").alias("title"), F.concat(F.lit("http://x/"), "doc_id").alias("url"),
        F.col("source").alias("domain"), F.col("lang").alias("language"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("seendate"))
    lines = docs.select(F.to_json(F.struct(F.array(article).alias("articles"))).alias("line"))
    return feeds.gdelt_articles(lines).select(
        "payload.url", "payload.title", F.md5("payload.text").alias("text_md5"), "payload.source", "payload.language",
        "timestamp")


@query("feed_forum_posts", f"""
SELECT CAST(doc_id AS VARCHAR) AS post_id, concat('reddit/', source) AS source, 0.65e0 AS confidence,
  md5({stripped("concat(text, ' ', text)")}) AS text_md5, n_chars AS score, CAST(doc_id * 60 AS DOUBLE) AS timestamp
FROM documents WHERE doc_id * 7919 % 240 <= 180""")
def feed_forum_posts(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    msg = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"),
        F.col("text").alias("selftext"), F.col("n_chars").alias("score"), F.col("source").alias("subreddit"),
        F.concat(F.lit("/r/"), "source").alias("permalink"), F.lit(0).alias("num_comments"),
        (F.col("doc_id") * 60.0).alias("created_utc")))
    # Arrival delays of 0 to 239 seconds, whatever the text: a quarter of the posts come too late.
    lines = docs.select(msg.alias("line"), (F.col("doc_id") * 60.0 + F.col("doc_id") * 7919 % 240).alias("received_at"))
    return feeds.forum_posts(lines, poll_seconds=60).select(
        "payload.post_id", "source", "confidence", F.md5("payload.text").alias("text_md5"),
        "payload.score", "timestamp")


@query("feed_short_posts", """
SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS tweet_id, md5(text) AS text_md5,
  CASE WHEN role = 'user' THEN turn ELSE 0 END AS likes, CAST(0 AS BIGINT) AS retweets,
  epoch_us(TIMESTAMP '2024-05-01 00:00:00' + turn * INTERVAL 1 SECOND) / 1e6 AS timestamp FROM conversations""")
def feed_short_posts(spark, sf_dir):
    talk = views.table(spark, sf_dir, "conversations")
    metrics = F.struct(F.col("turn").alias("like_count"))
    post = F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.col("text"),
        F.concat(F.lit("2024-05-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z")).alias("created_at"),
        F.when(F.col("role") == "user", metrics).alias("public_metrics"))
    lines = talk.groupBy("conv_id", F.floor(F.col("turn") / 50)).agg(F.collect_list(post).alias("data")).select(
        F.to_json(F.struct("data")).alias("line"))
    return feeds.short_posts(lines).select(
        "payload.tweet_id", F.md5("payload.text").alias("text_md5"), "payload.likes", "payload.retweets", "timestamp")


def raw_events(spark, sf_dir):
    """Raw events of four types plus an unknown one, some with unreadable numbers."""
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    text = lambda c: c.cast("string")
    payload = F.to_json(F.struct(
        F.concat(F.lit("S"), F.col("user_id") % 5).alias("symbol"),
        F.when(F.col("value") < 1, "n/a").otherwise(text(F.col("value"))).alias("mid"),
        text(F.col("value") - 0.5).alias("bid"),
        F.when(F.col("value") > 20, text(F.col("value") + 1)).alias("ask"), text(F.col("user_id") - 20).alias("volume"),
        F.col("props").alias("title"), F.concat(F.lit(" "), "props", F.lit(" ")).alias("text"),
        F.concat(F.lit("u"), "user_id").alias("description"), F.lit("FEDFUNDS").alias("event"),
        F.lit("us").alias("country"), text(F.col("user_id")).alias("likes"),
        F.when(F.col("value") > 5, text(F.col("value"))).otherwise(".").alias("value")))
    kinds = (F.when(kind == "click", "market").when(kind == "view", "news").when(kind == "signup", "sentiment")
             .when(kind == "purchase", "macro").otherwise("other"))
    return e.select("event_id", seconds().alias("timestamp"), kinds.alias("type"), payload.alias("payload"),
                    F.lit("test").alias("source"), F.lit(1.0).alias("confidence"))


@query("normalize_market", f"""
SELECT event_id, symbol, {rounded_sql({"bid": 4, "ask": 4, "mid": 4, "spread": 4})}, volume FROM (
  SELECT event_id, concat('S', user_id % 5) AS symbol, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread,
    greatest(0e0, CAST(user_id - 20 AS DOUBLE)) AS volume
  FROM (SELECT *, value - 0.5e0 AS bid, CASE WHEN value > 20 THEN value + 1e0 ELSE value END AS ask
        FROM events WHERE event_type = 'click' AND value >= 1))""")
def normalize_market(spark, sf_dir):
    good = normalize.route(raw_events(spark, sf_dir))["market"]
    return rounded(good.select("event_id", "symbol", "bid", "ask", "mid", "spread", "volume"),
                   {"bid": 4, "ask": 4, "mid": 4, "spread": 4})


@query("normalize_news", f"""
SELECT event_id, {stripped("props")} AS title, {stripped("props")} AS text FROM events WHERE event_type = 'view'""")
def normalize_news(spark, sf_dir):
    return normalize.news(raw_events(spark, sf_dir)).select("event_id", "title", "text")


@query("normalize_sentiment", f"""
SELECT event_id, {stripped(f"concat({stripped('props')}, ' ', {stripped('props')})")} AS text, user_id AS likes, CAST(0 AS BIGINT) AS score
FROM events WHERE event_type = 'signup'""")
def normalize_sentiment(spark, sf_dir):
    return normalize.sentiment(raw_events(spark, sf_dir)).select("event_id", "text", "likes", "score")


@query("normalize_macro", """
SELECT event_id, 'FEDFUNDS' AS series_id, 'US' AS country, CASE WHEN value > 5 THEN value END AS value,
  'medium' AS impact, 'FED_RATE' AS event_type, 1e0 AS impact_score, 'FED' AS node
FROM events WHERE event_type = 'purchase'""")
def normalize_macro(spark, sf_dir):
    out = normalize.series_category(normalize.macro(raw_events(spark, sf_dir)))
    return out.select("event_id", "series_id", "country", "value", "impact", "event_type", "impact_score",
                      normalize.causal_node(F.col("series_id")).alias("node"))


@query("normalize_rejected", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'market' ELSE 'other' END AS type
FROM events WHERE event_type = 'error' OR (event_type = 'click' AND value < 1)""")
def normalize_rejected(spark, sf_dir):
    return normalize.route(raw_events(spark, sf_dir))["rejected"].select("event_id", "type")


@query("normalize_market_nulls", """
SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 2e0 END AS mid,
  CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 3 = 2 THEN 7e0 ELSE 0e0 END END AS volume FROM events""")
def normalize_market_nulls(spark, sf_dir):
    """Quotes whose middle is null or unreadable are rejected though both sides are known; a blank volume is zero."""
    i = F.col("event_id")
    mid = F.when(i % 4 == 0, "null").when(i % 4 == 2, '"n/a"').otherwise(F.col("value").cast("string"))
    volume = F.when(i % 3 == 0, '""').when(i % 3 == 1, "null").otherwise("7")
    raw = events(spark, sf_dir).select(
        "event_id", seconds().alias("timestamp"), F.lit("market").alias("type"),
        F.concat(F.lit('{"mid":'), mid, F.lit(',"bid":1.5,"ask":2.5,"volume":'), volume, F.lit("}")).alias("payload"),
        F.lit("test").alias("source"), F.lit(1.0).alias("confidence"))
    routed = normalize.route(raw)
    none = F.lit(None).cast("double")
    return routed["market"].select("event_id", "mid", "volume").unionByName(
        routed["rejected"].select("event_id", none.alias("mid"), none.alias("volume")))


@query("event_counts", """
SELECT CASE event_type WHEN 'click' THEN 'market' WHEN 'view' THEN 'news' WHEN 'signup' THEN 'sentiment'
            WHEN 'purchase' THEN 'macro' ELSE 'other' END AS type, count(*) AS n FROM events GROUP BY 1""")
def event_counts(spark, sf_dir):
    return bars.event_counts(raw_events(spark, sf_dir))


@query("feed_union", """
SELECT type, source, count(*) AS n FROM (
  SELECT 'market' AS type, 'twelve_data' AS source FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'news', 'newsapi' FROM conversations
  UNION ALL SELECT 'news', 'newsapi' FROM conversations WHERE false) GROUP BY 1, 2""")
def feed_union(spark, sf_dir):
    united = feeds.unite(feeds.tick_messages(tick_lines(spark, sf_dir)),
                         feeds.news_articles(article_lines(spark, sf_dir)))
    return united.groupBy("type", "source").agg(F.count("*").alias("n"))


@query("logical_clock", """
WITH r AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 281474976710656 AS received,
                  row_number() OVER (ORDER BY event_id) AS n FROM events)
SELECT event_id, n + greatest(0, max(received - n + 1) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS logical_t
FROM r""")
def logical_clock(spark, sf_dir):
    return bars.logical_clock(events(spark, sf_dir)).select("event_id", "logical_t")


@query("dedup_first_seen", """
SELECT event_id, user_id, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def dedup_first_seen(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "props")
    return bars.first_seen(e, ["user_id", "props"], ["event_id"])


def _candle_sql(seconds_: int) -> str:
    return with_views(["ticks"], f"""
SELECT symbol, CAST(floor(epoch_us(ts) / {seconds_}e6) AS BIGINT) * {seconds_} AS t,
  arg_min(mid, (ts, event_id)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (ts, event_id)) AS close,
  sum(volume) AS volume FROM ticks GROUP BY ALL""")


@query("candles_60s", _candle_sql(60))
def candles_60s(spark, sf_dir):
    return bars.candles(views.ticks(spark, sf_dir), "60 seconds")


@query("candles_1h", _candle_sql(3600))
def candles_1h(spark, sf_dir):
    return bars.candles(views.ticks(spark, sf_dir), "1 hour")


@query("candles_last", f"""SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM ({_candle_sql(3600)})) WHERE k <= 200""")
def candles_last(spark, sf_dir):
    return bars.latest_rows(bars.candles(views.ticks(spark, sf_dir), "1 hour"), ("symbol",), [F.desc("t")], 200)


@query("latest_snapshot", with_views(["ticks"], """
SELECT symbol, arg_max(mid, (ts, event_id)) AS mid, arg_max(spread, (ts, event_id)) AS spread, max(event_id) AS event_id
FROM (SELECT * FROM ticks) GROUP BY symbol"""))
def latest_snapshot(spark, sf_dir):
    return bars.latest_snapshot(views.ticks(spark, sf_dir), ("symbol",), ("ts", "event_id"), ["mid", "spread", "event_id"])


@query("macro_observations", with_views(["macro_d"], """
SELECT CAST(date AS VARCHAR) AS date, series_id, value FROM macro_d WHERE value > 2"""))
def macro_observations(spark, sf_dir):
    obs = views.macro_d(spark, sf_dir)
    item = F.struct(F.col("date").cast("string").alias("date"),
                    F.when(F.col("value") > 2, F.col("value").cast("string")).otherwise(".").alias("value"))
    lines = obs.groupBy("series_id", F.year("date")).agg(F.collect_list(item).alias("observations")).select(
        F.to_json(F.struct("series_id", "observations")).alias("line"))
    return history.macro_observations(lines).withColumn("date", F.col("date").cast("string"))


@query("bars_wide_to_long", with_views(["prices_d"], """
SELECT CAST(date AS VARCHAR) AS date, symbol, open, high, low, close, volume, 'yahoo' AS source FROM prices_d"""))
def bars_wide_to_long(spark, sf_dir):
    p = views.prices_d(spark, sf_dir)
    fields = ["open", "high", "low", "close", "volume"]
    symbols = [r.symbol for r in p.select("symbol").distinct().orderBy("symbol").collect()]  # as many as wide columns
    wide = p.groupBy("date").agg(*[
        F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}|{f.capitalize()}") for s in symbols for f in fields])
    return history.long_bars(wide, symbols).withColumn("date", F.col("date").cast("string"))


@query("fund_flows", with_views(["etf_holdings"], f"""
f AS (SELECT date, shares_out * nav AS aum_usd,
      (shares_out - lag(shares_out) OVER (ORDER BY date)) * nav AS flow_usd FROM etf_holdings)
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql({"aum_usd": 6, "flow_usd": 6})} FROM f"""))
def fund_flows(spark, sf_dir):
    out = history.fund_flows(views.etf_holdings(spark, sf_dir))
    return rounded(out.select(F.col("date").cast("string").alias("date"), "aum_usd", "flow_usd"),
                   {"aum_usd": 6, "flow_usd": 6})


@query("positioning_from_wide", with_views(["cot_disagg"], """
SELECT CAST(report_date AS VARCHAR) AS report_date, contract, open_interest, mm_long, mm_short,
  CAST(NULL AS DOUBLE) AS swap_long FROM cot_disagg"""))
def positioning_from_wide(spark, sf_dir):
    c = views.cot_disagg(spark, sf_dir)
    wide = c.select(
        F.lit(" 088691 ").alias("CFTC Contract Market Code"),
        F.date_format("report_date", "MM/dd/yyyy").alias("Report_Date_as_MM_DD_YYYY"),
        F.col("open_interest").cast("string").alias("Open_Interest_All"),
        F.concat(F.lit(" "), F.col("mm_long").cast("string")).alias("M_Money__Positions_Long_All"),
        F.col("mm_short").alias("M_MONEY_POSITIONS_SHORT_ALL"))
    out = history.positioning(wide)
    return out.select(F.col("report_date").cast("string").alias("report_date"), "contract", "open_interest",
                      "mm_long", "mm_short", "swap_long")


@query("statement_dates", """
SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders""")
def statement_dates(spark, sf_dir):
    links = F.concat(F.lit('<a href="/newsevents/monetary'), F.date_format("o_orderdate", "yyyyMMdd"),
                     F.lit('a.htm">x</a> monetary99999999a.htm'))
    pages = views.table(spark, sf_dir, "orders").select(links.alias("html"))
    return history.statement_dates(pages).select(F.col("date").cast("string").alias("date"))
