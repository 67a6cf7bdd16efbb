"""Parsers from landed feed messages to raw events.

Each parser takes a frame with one message per row in a text column (default `line`) and gives
timestamp (epoch seconds), type, payload (struct), source, confidence; other columns pass through.
They are stateless projections, so they run on batch and streaming frames alike. Unreadable
timestamps become null (see `quarantine`), and offsets in timestamps are honoured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import head, strip
from tidemark.functions.numeric import d
from tidemark.schemas import RAW_EVENT

HIGH_IMPACT = ("FEDFUNDS", "CPIAUCSL", "UNRATE", "GDP", "T10YIE")  # fixed values


def _event(df: DataFrame, line: str, ts: Column, kind: str, payload: list[Column], source: Column | str,
           confidence: float, extra: tuple[str, ...] = ()) -> DataFrame:
    keep = [F.col(c) for c in df.columns if c not in (line, "m", "a", *extra)]
    src = F.lit(source) if isinstance(source, str) else source
    return df.select(*keep, ts.alias("timestamp"), F.lit(kind).alias("type"), F.struct(*payload).alias("payload"),
                     src.alias("source"), d(confidence).alias("confidence"))


def _json(df: DataFrame, line: str, ddl: str) -> DataFrame:
    # As a generator the parsed message is computed once; a filter on a column would parse it again.
    return df.select("*", F.explode(F.array(F.from_json(line, ddl))).alias("m"))


def _num(c: str | Column, default: Column | float | None = None) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    if default is None:
        return x
    return F.coalesce(x, default if isinstance(default, Column) else d(default))


def _words(*parts: Column) -> Column:
    """Join the non-empty parts with a space."""
    return strip(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def _cut(c: Column, width: int | None) -> Column:
    return head(strip(F.coalesce(c, F.lit(""))), width)


def iso_seconds(c: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(c)) / 1e6


def compact_seconds(c: Column) -> Column:
    """yyyyMMddHHmmss, UTC."""
    return F.unix_micros(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))) / 1e6


def tick_messages(df: DataFrame, line: str = "line") -> DataFrame:
    """Price ticks of a quote stream; heartbeats and acknowledgements are dropped."""
    df = _json(df, line, "event string, timestamp string, symbol string, price string, bid string, ask string, "
                         "day_volume string, exchange string").where(F.col("m.event") == "price")
    price = _num("m.price", 0)
    return _event(df, line, _num("m.timestamp"), "market", [
        F.coalesce("m.symbol", F.lit("XAU/USD")).alias("symbol"), price.alias("mid"),
        _num("m.bid", price).alias("bid"), _num("m.ask", price).alias("ask"),
        # An absent side counts as zero here, unlike in bid and ask themselves.
        (_num("m.ask", 0) - _num("m.bid", 0)).alias("spread"),
        _num("m.day_volume", 0).alias("volume"), F.coalesce("m.exchange", F.lit("")).alias("exchange"),
    ], "twelve_data", 1.0)


def rate_quotes(df: DataFrame, line: str = "line", received: str = "received_at") -> DataFrame:
    """Exchange-rate replies with numbered keys; the reply carries no time, so arrival time is used."""
    df = _json(df, line, "`Realtime Currency Exchange Rate` map<string,string>")
    rate = F.col("m").getField("Realtime Currency Exchange Rate")
    df = df.where(F.coalesce(F.size(rate), F.lit(0)) > 0)
    price = _num(F.element_at(rate, "5. Exchange Rate"), 0)
    bid, ask = _num(F.element_at(rate, "8. Bid Price"), price), _num(F.element_at(rate, "9. Ask Price"), price)
    return _event(df, line, F.col(received).cast("double"), "market", [
        F.lit("XAU/USD").alias("symbol"), price.alias("mid"), bid.alias("bid"), ask.alias("ask"),
        (ask - bid).alias("spread"), d(0).alias("volume")], "alpha_vantage", 0.9, (received,))


def broker_prices(df: DataFrame, line: str = "line") -> DataFrame:
    """Price lines with ladders of bids and asks; the best level is the first."""
    side = "array<struct<price:string>>"
    df = _json(df, line, f"type string, time string, bids {side}, asks {side}, tradeable boolean")
    df = df.where(F.col("m.type") == "PRICE")
    bid = _num(F.get(F.col("m.bids"), 0).getField("price"), 0)
    ask = _num(F.get(F.col("m.asks"), 0).getField("price"), 0)
    return _event(df, line, _num("m.time"), "market", [
        F.lit("XAU/USD").alias("symbol"), bid.alias("bid"), ask.alias("ask"), ((bid + ask) / 2).alias("mid"),
        (ask - bid).alias("spread"), d(0).alias("volume"),
        F.coalesce("m.tradeable", F.lit(True)).alias("tradeable")], "oanda", 1.0)


def _articles(df: DataFrame, line: str, article: str, status: bool) -> DataFrame:
    df = _json(df, line, f"status string, articles array<struct<{article}>>")
    if status:
        df = df.where(F.col("m.status") == "ok")
    return df.withColumn("a", F.explode("m.articles"))


def news_articles(df: DataFrame, line: str = "line", title_width: int | None = None, text_width: int | None = None) -> DataFrame:
    """Articles of a news search; titles and descriptions are whole unless widths are given."""
    df = _articles(df, line, "title:string, description:string, url:string, author:string, publishedAt:string, "
                             "source:struct<name:string>", True)
    blank = F.lit("")
    return _event(df, line, iso_seconds(F.col("a.publishedAt")), "news", [
        _cut(F.col("a.title"), title_width).alias("title"), _cut(F.col("a.description"), text_width).alias("description"),
        _words(F.col("a.title"), F.col("a.description")).alias("text"),
        F.coalesce("a.source.name", blank).alias("source"), F.coalesce("a.url", blank).alias("url"),
        F.coalesce("a.author", blank).alias("author")], "newsapi", 0.85)


def gdelt_articles(df: DataFrame, line: str = "line", title_width: int | None = None) -> DataFrame:
    df = _articles(df, line, "title:string, url:string, domain:string, language:string, seendate:string", False)
    blank = F.lit("")
    return _event(df, line, compact_seconds(F.col("a.seendate")), "news", [
        _cut(F.col("a.title"), title_width).alias("title"), strip(F.coalesce("a.title", blank)).alias("text"),
        F.coalesce("a.domain", blank).alias("source"), F.coalesce("a.url", blank).alias("url"),
        F.coalesce("a.language", blank).alias("language")], "gdelt", 0.70)


def forum_posts(df: DataFrame, line: str = "line", received: str = "received_at", poll_seconds: float = 60,
                title_width: int | None = None, body_width: int | None = None) -> DataFrame:
    """Posts no older than three polling intervals at arrival; whole titles and bodies unless widths are given."""
    df = _json(df, line, "id string, title string, selftext string, score long, subreddit string, "
                         "permalink string, num_comments long, created_utc double")
    df = df.where(F.col(received).cast("double") - F.col("m.created_utc") <= 3 * poll_seconds)
    return _event(df, line, F.col("m.created_utc"), "sentiment", [
        head(F.col("m.title"), title_width).alias("title"),
        _words(F.col("m.title"), head(F.col("m.selftext"), body_width)).alias("text"),
        F.col("m.score").alias("score"), F.col("m.subreddit").alias("subreddit"),
        F.concat(F.lit("https://reddit.com"), "m.permalink").alias("url"),
        F.col("m.num_comments").alias("num_comments"), F.col("m.id").alias("post_id")],
        F.concat(F.lit("reddit/"), F.col("m.subreddit")), 0.65, (received,))


def short_posts(df: DataFrame, line: str = "line", since_id: int | None = None, text_width: int | None = None) -> DataFrame:
    """Search replies of short posts, whole unless a width is given; `since_id` drops posts already read."""
    count = "like_count:long, retweet_count:long, reply_count:long, impression_count:long"
    df = _json(df, line, f"data array<struct<id:string, text:string, created_at:string, "
                         f"public_metrics:struct<{count}>>>").withColumn("a", F.explode("m.data"))
    if since_id is not None:
        df = df.where(F.col("a.id").try_cast("long") > since_id)
    zero = F.lit(0).cast("long")
    metric = lambda n: F.coalesce(F.col(f"a.public_metrics.{n}"), zero)
    return _event(df, line, iso_seconds(F.col("a.created_at")), "sentiment", [
        head(F.coalesce("a.text", F.lit("")), text_width).alias("text"),
        F.coalesce("a.id", F.lit("")).alias("tweet_id"), metric("like_count").alias("likes"),
        metric("retweet_count").alias("retweets"), metric("reply_count").alias("replies"),
        metric("impression_count").alias("impressions")], "twitter", 0.60)


def as_raw_events(parsed: DataFrame) -> DataFrame:
    """Fold the payload to JSON so that feeds with different payloads can be united."""
    cols = [F.to_json("payload").alias("payload") if f.name == "payload" else F.col(f.name) for f in RAW_EVENT]
    return parsed.select(*cols)


def unite(*feeds: DataFrame) -> DataFrame:
    """One feed of raw events from many."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [as_raw_events(f) for f in feeds])


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off events without a readable time."""
    ok = F.col("timestamp").isNotNull()
    return events.where(ok), events.where(~ok)


def read_messages(spark, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Landed message files, one JSON text per line."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").options(**options).load(path).withColumnRenamed("value", "line")


def changed_observations(obs: DataFrame, keys: tuple[str, ...] = ("series_id",), at: str = "date",
                         value: str = "value") -> DataFrame:
    """Observations whose value differs from the previous valid one of the series.

    A series has one row per date, so the window is bounded by the calendar.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(at)
    valid = obs.where(F.col(value).isNotNull()).withColumn("_prev", F.lag(value).over(w))
    return valid.where(F.col("_prev").isNull() | (F.col("_prev") != F.col(value))).drop("_prev")


def newest_observation(obs: DataFrame, key: str = "series_id", at: str = "date", value: str = "value") -> DataFrame:
    """The newest valid observation per series, marked with its impact class."""
    out = obs.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.max(at).alias(at), F.max_by(value, at).alias(value))
    return out.withColumn("impact", F.when(F.col(key).isin(*HIGH_IMPACT), "high").otherwise("medium"))
