"""News jobs: daily signal, top headlines, rows awaiting extraction, storing extraction results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, d


def new_york_date(ts: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), "America/New_York"))


def latest_version(features: DataFrame) -> DataFrame:
    """One feature row per headline: the one extracted last, then the one of the highest version (v10 after v9)."""
    others = [c for c in features.columns if c != "news_id"]
    number = F.regexp_extract("model_version", r"(\d+)\D*$", 1).try_cast("decimal(38,0)")
    order = [*[F.col(c) for c in ("extracted_at",) if c in features.columns], number, F.col("model_version")]
    return (features.groupBy("news_id").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
            .select("news_id", "_row.*"))


def daily_signal(news: DataFrame, features: DataFrame, start: str | None = None,
                 latest_version_only: bool = True) -> DataFrame:
    """Confidence-weighted impact, count of confident novel items and dispersion per New York date."""
    f = latest_version(features) if latest_version_only else features
    f = f.where(F.col("gold_impact").isNotNull() & F.col("confidence").isNotNull()).select(
        "news_id", "gold_impact", "confidence", "novel")
    n = news.select("id", new_york_date("ts").alias("date"))
    if start:
        n = n.where(F.col("date") >= F.lit(start).cast("date"))
    j = n.join(f, n["id"] == f["news_id"])
    w = clip(F.col("confidence"), 0, 1)
    hot = (F.col("confidence") >= 0.5) & F.coalesce("novel", F.lit(False))
    return j.groupBy("date").agg(
        F.coalesce(F.sum(F.col("gold_impact") * w) / F.nullif(F.sum(w), d(0)), d(0)).alias("impact_wmean"),
        F.count_if(hot).alias("intensity"),
        F.coalesce(F.stddev_samp("gold_impact"), d(0)).alias("dispersion"))


def top_headlines(news: DataFrame, features: DataFrame, n: int = 8, day: str | None = None) -> DataFrame:
    """The n strongest headlines per UTC day; one day if `day` is given."""
    rows = news.select("id", "title", F.to_date("ts").alias("date"))
    if day:
        rows = rows.where(F.col("date") == F.lit(day).cast("date"))
    f = features.drop("ts")
    score = F.col("confidence") * F.abs("gold_impact")
    j = rows.join(f, rows["id"] == f["news_id"]).withColumn("score", score)
    w = Window.partitionBy("date").orderBy(F.desc_nulls_last("score"), "id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pending(news: DataFrame, features: DataFrame, model_version: str, limit: int | None = None) -> DataFrame:
    """Headlines without features for this model version, newest first; body is title and text."""
    done = features.where(F.col("model_version") == model_version).select(F.col("news_id").alias("id"))
    blank = F.lit("")
    out = news.join(done, "id", "left_anti").select(
        "id", "ts", F.concat(F.coalesce("title", blank), F.lit(" "), F.coalesce("text", blank)).alias("body"))
    return out.orderBy(F.desc("ts"), "id").limit(limit) if limit else out


def extract(rows: DataFrame, backend: Callable[[str], str | None]) -> DataFrame:
    """Run a user-supplied extraction function over pending rows; it returns the reply text or None."""
    def apply(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(reply=[backend(t) for t in pdf["body"]])[["id", "reply"]]

    return rows.select("id", "body").mapInPandas(apply, "id string, reply string")


REPLY = ("event_type string, gold_impact string, confidence string, horizon_minutes string, novel string, "
         "surprise_signed string, rationale string")


def recovered_json(reply: Column) -> Column:
    """The JSON object inside a reply: fences stripped, else from the first brace to the last."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.nullif(inner, F.lit(""))


def coerce_features(replies: DataFrame, model_version: str) -> DataFrame:
    """Typed, clipped feature rows from extraction replies; replies without a JSON object are dropped."""
    rows = replies.withColumn("_json", recovered_json(F.col("reply"))).where(F.col("_json").isNotNull())
    rows = rows.withColumn("m", F.from_json("_json", REPLY)).where(F.col("m").isNotNull())

    def number(name: str, lo: float, hi: float) -> Column:
        return clip(F.coalesce(F.col(f"m.{name}").try_cast("double"), d(0)), lo, hi).alias(name)

    horizon = F.coalesce(F.nullif(F.col("m.horizon_minutes").try_cast("int"), F.lit(0)), F.lit(60))
    return rows.select(
        F.col("id").alias("news_id"), F.lit(model_version).alias("model_version"),
        F.current_timestamp().alias("extracted_at"),
        F.substring(F.coalesce("m.event_type", F.lit("other")), 1, 32).alias("event_type"),
        number("gold_impact", -1, 1), number("confidence", 0, 1),
        F.greatest(F.lit(5), F.least(F.lit(10080), horizon)).alias("horizon_minutes"),
        F.coalesce(F.col("m.novel").try_cast("boolean"), F.lit(False)).alias("novel"),
        number("surprise_signed", -1, 1),
        F.substring(F.coalesce("m.rationale", F.lit("")), 1, 240).alias("rationale"))


def embed(rows: DataFrame, embedding: Callable[[list[str]], list[list[float]]], text: str = "body", key: str = "id"
          ) -> DataFrame:
    """Run a user-supplied embedding function over batches of whole texts."""
    def apply(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(topic_embedding=list(embedding(pdf[text].tolist())))[[key, "topic_embedding"]]

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(apply, f"{key} {kind}, topic_embedding array<float>")
