"""Streaming queries: each drains its stream over a restart and is compared with the SQL of the batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark import views
from tidemark.catalog import ORACLES, query, rounded, rounded_sql, with_views
from tidemark.catalog import daily, feeds, macro, models, news, scans, ticks  # noqa: F401  their SQL is compared with
from tidemark.session import shared_dir
from tidemark.sources import feeds as sources
from tidemark.sources.lake import Lake
from tidemark.streaming import jobs, sinks

ONCE = {"availableNow": True}
#: Rows that a stream with state of its own rows takes at a time: one key may hold them all, in one Python worker.
LANDED_ROWS = 1_500_000


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(df: DataFrame, at: str, start: Callable[[DataFrame, str], StreamingQuery], rows: int | None = None) -> str:
    """Land `df` in two parts by `at`, or in more of about `rows` rows; after each the stream runs to the end of its input.

    Each further run begins from the checkpoint of the one before, so state and watermark have to survive a restart.
    More than two parts are written apart once, so each is read alone. Rows of one `at` are in one part.
    """
    spark, base = df.sparkSession, new_folder(df.sparkSession, "stream")
    middle = F.percentile_approx(at, F.lit(0.5)).alias("m")
    size = df.agg(F.count(at).alias("n"), middle).first()
    parts = max(2, -(-size.n // rows)) if rows else 2
    if parts == 2:
        landings = [df.where(F.col(at) <= F.lit(size.m)), df.where(F.col(at) > F.lit(size.m))]
    else:
        points = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        bounds = sorted(set(df.agg(F.percentile_approx(at, points, F.lit(100 * parts)).alias("b")).first().b))
        number = F.lit(0)
        for i, bound in enumerate(bounds, 1):
            number = F.when(F.col(at) > F.lit(bound), F.lit(i)).otherwise(number)
        df.where(F.col(at).isNotNull()).withColumn("_landing", number).write.partitionBy("_landing").parquet(f"{base}/parts")
        apart = spark.read.schema(StructType([*df.schema, StructField("_landing", IntegerType())])).parquet(f"{base}/parts")
        landings = [apart.where(F.col("_landing") == i).drop("_landing") for i in range(len(bounds) + 1)]
    for part in landings:
        part.write.mode("append").option("compression", "zstd").parquet(f"{base}/landed")
        start(spark.readStream.schema(df.schema).parquet(f"{base}/landed"), base).awaitTermination()
    return base


def drained(df: DataFrame, at: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that the stream appends."""
    schema = []

    def start(source: DataFrame, base: str) -> StreamingQuery:
        out = transform(source)
        schema[:] = [out.schema]
        return (out.writeStream.format("parquet").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/checkpoint").trigger(**ONCE).start())

    base = streamed(df, at, start, LANDED_ROWS)
    return df.sparkSession.read.schema(schema[0]).parquet(f"{base}/out")


def timed_ticks(spark, sf_dir) -> DataFrame:
    return views.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def in_seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_micros("ts") / 1e6)


@query("stream_feed_messages", f"SELECT * EXCLUDE (event_id) FROM ({ORACLES['feed_tick_messages']})")
def stream_feed_messages(spark, sf_dir):
    """Message files read as a stream and parsed."""
    base = new_folder(spark, "messages")
    feeds.tick_lines(spark, sf_dir).select("line").write.text(f"{base}/landed")
    parsed = sources.tick_messages(sources.read_messages(spark, f"{base}/landed", stream=True)).select(
        "payload.symbol", "payload.mid", "payload.bid", "payload.ask", "payload.spread", "payload.volume", "source",
        F.round("timestamp", 3).alias("timestamp"))
    (parsed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
     .trigger(**ONCE).start().awaitTermination())
    return rounded(spark.read.schema(parsed.schema).parquet(f"{base}/out"), {"mid": 4, "bid": 4, "ask": 4, "spread": 4})


@query("stream_normalize_market", ORACLES["normalize_market"])
def stream_normalize_market(spark, sf_dir):
    out = drained(feeds.raw_events(spark, sf_dir), "timestamp", lambda s: jobs.normalise(s)["market"])
    return rounded(out.select("event_id", "symbol", "bid", "ask", "mid", "spread", "volume"),
                   {"bid": 4, "ask": 4, "mid": 4, "spread": 4})


@query("stream_normalize_rejected", ORACLES["normalize_rejected"])
def stream_normalize_rejected(spark, sf_dir):
    out = drained(feeds.raw_events(spark, sf_dir), "timestamp", lambda s: jobs.normalise(s)["rejected"])
    return out.select("event_id", "type")


@query("stream_candles", f"""SELECT * FROM ({ORACLES["candles_1h"]}) WHERE t + 3600 <=
  (SELECT epoch_ms(max(ts)) / 1e3 - 60 FROM events WHERE value > 0)""")
def stream_candles(spark, sf_dir):
    """Candles whose hour is past the watermark, a minute behind the newest tick."""
    return drained(timed_ticks(spark, sf_dir), "ts", lambda s: jobs.candle_stream(s, "1 hour", "1 minute"))


@query("stream_dedup", "SELECT DISTINCT user_id, props FROM events")
def stream_dedup(spark, sf_dir):
    e = feeds.events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "props")
    return drained(e, "ts", lambda s: jobs.dedup_stream(s, ["user_id", "props"], within="3650 days")).select("user_id", "props")


@query("stream_changed_values", ORACLES["macro_change_only"])
def stream_changed_values(spark, sf_dir):
    m = views.macro_d(spark, sf_dir).withColumn("value", F.round("value", 0))
    out = drained(m, "date", jobs.changed_values)
    return out.select(F.col("date").cast("string").alias("date"), "series_id", "value")


@query("stream_fusion", f"""
SELECT event_id, mid, CAST(text AS DOUBLE) AS text, macro FROM ({ORACLES["fusion_latest_values"]})""")
def stream_fusion(spark, sf_dir):
    """Ticks with the newest headline length and macro value; feeds without a symbol reach all symbols."""
    tick = timed_ticks(spark, sf_dir)
    symbols = [f"S{i}" for i in range(5)]
    none = F.lit(None).cast("string").alias("symbol")
    text = views.news(spark, sf_dir).select(F.lit("text").alias("kind"), none, F.col("ts").cast("timestamp").alias("ts"),
                                            F.lit(None).cast("long").alias("event_id"), F.length("title").cast("double").alias("mid"))
    error = feeds.events(spark, sf_dir).where("event_type = 'error'").select(
        F.lit("macro").alias("kind"), none, F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("mid"))
    landed = tick.select(F.lit("tick").alias("kind"), "symbol", "ts", "event_id", "mid").unionByName(text).unionByName(error)

    def fused(s: DataFrame) -> DataFrame:
        values = {k: s.where(F.col("kind") == k).select("ts", F.col("mid").alias("value")) for k in ("text", "macro")}
        return jobs.latest_value_stream(jobs.fusion_rows(s.where("kind = 'tick'"), values, symbols), ["text", "macro"])

    return drained(landed, "ts", fused).select("event_id", "mid", "text", "macro")


_STATE = {"macd": 6, "macd_signal": 6, "z_price": 6, "sigma": 6, "confidence": 6, "vwap_dev": 6}


@query("stream_symbol_state", f"""
SELECT m.event_id, m.symbol, macd, macd_signal, z_price, sigma, value AS confidence, vwap_dev
FROM ({ORACLES["tick_macd"]}) m JOIN ({ORACLES["tick_robust_z"]}) z USING (event_id)
JOIN ({ORACLES["garch"].replace("ln(mid / prev) / 1e2", "ln(mid / prev)")}) g USING (event_id)
JOIN ({ORACLES["kalman_confidence"]}) k USING (event_id) JOIN ({ORACLES["session_vwap_elapsed"]}) s USING (event_id)""")
def stream_symbol_state(spark, sf_dir):
    """Running indicators, with the session price deviation, from the state of each symbol."""
    t = timed_ticks(spark, sf_dir).withColumn("obs", F.col("volume") / 97.0)
    out = drained(t, "ts", lambda s: jobs.symbol_state(in_seconds(s)))
    return rounded(out.select("event_id", "symbol", *_STATE), _STATE)


@query("stream_settlement", with_views(["ticks"], f"""
r AS (SELECT event_id, symbol, h AS horizon, ln(CASE h WHEN 5 THEN lead(mid, 5) OVER w ELSE lead(mid, 30) OVER w END / mid) AS realised,
    volume / 1e4 AS pred FROM ticks, (VALUES (5), (30)) v(h) WINDOW w AS (PARTITION BY symbol, h ORDER BY ts, event_id)),
e AS (SELECT *, abs(realised - pred) AS abs_error FROM r WHERE realised IS NOT NULL)
SELECT event_id, symbol, CAST(horizon AS INTEGER) AS horizon, {rounded_sql({"realised": 6, "abs_error": 6})} FROM e"""))
def stream_settlement(spark, sf_dir):
    """Each prediction settled once the ticks of its horizon have come."""
    t = timed_ticks(spark, sf_dir).withColumn("pred", F.col("volume") / 1e4)
    out = drained(t, "ts", lambda s: jobs.delayed_settlement(s.select("symbol", "ts", "event_id", "mid", "pred")))
    return rounded(out, {"realised": 6, "abs_error": 6})


@query("stream_news_sink", ORACLES["news_sink_rows"])
def stream_news_sink(spark, sf_dir):
    """News upserted batch by batch into the lake; every message comes twice."""
    raw = news.raw_news(spark, sf_dir)
    lake = Lake(spark, new_folder(spark, "lake"))
    streamed(raw.unionByName(raw), "timestamp",
             lambda s, base: sinks.start_news_sink(s, lake, f"{base}/checkpoint", ONCE))
    return lake.read("news").select("id", "source", "title", F.md5("text").alias("text_md5"))


@query("stream_snapshot", with_views(["ticks"], """
SELECT symbol, max(event_id) AS event_id, arg_max(mid, event_id) AS mid, arg_max(volume, event_id) AS volume FROM ticks
GROUP BY symbol"""))
def stream_snapshot(spark, sf_dir):
    """The newest row of each symbol, kept by micro-batches."""
    path = new_folder(spark, "snapshot")
    streamed(timed_ticks(spark, sf_dir).select("ts", "symbol", "event_id", "mid", "volume"), "ts",
             lambda s, base: sinks.start_snapshot_sink(s, ["symbol"], "event_id", path, f"{base}/checkpoint", ONCE))
    return sinks.latest_snapshot(spark, path).select("symbol", "event_id", "mid", "volume")


@query("stream_packets", ORACLES["packets"])
def stream_packets(spark, sf_dir):
    """Packets handed to a user function, which here writes each batch to a folder of its own."""
    path = new_folder(spark, "packets")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    streamed(timed_ticks(spark, sf_dir), "ts", lambda s, base: sinks.start_callback(
        sinks.packet_json(models.packet_rows(s)), keep, f"{base}/checkpoint", ONCE))
    return models.packet_values(spark.read.parquet(path))
