"""Normalise raw events into four typed frames; stateless, so the same code runs on a stream.

A raw event has timestamp (epoch seconds), type, payload (JSON text), source and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import head, strip
from tidemark.functions.numeric import d
from tidemark.schemas import PAYLOADS

TYPES = ("market", "news", "sentiment", "macro")

# Series -> (category, base impact), and the category order of the one-hot vector.
SERIES_IMPACT = {
    "FEDFUNDS": ("FED_RATE", 1.00),
    "CPIAUCSL": ("CPI", 0.95),
    "UNRATE": ("UNEMPLOYMENT", 0.80),
    "DGS10": ("YIELD_10Y", 0.90),
    "DGS2": ("YIELD_2Y", 0.80),
    "DTWEXBGS": ("USD_INDEX", 0.85),
    "VIXCLS": ("VIX", 0.85),
    "DCOILWTICO": ("OIL_WTI", 0.70),
    "GOLDAMGBD228NLBM": ("GOLD_FIX", 0.75),
    "GDP": ("GDP", 0.85),
    "T10YIE": ("BREAKEVEN_INFL", 0.90),
}
CATEGORIES = ["FED_RATE", "CPI", "UNEMPLOYMENT", "YIELD_10Y", "YIELD_2Y", "USD_INDEX", "VIX", "OIL_WTI",
              "GOLD_FIX", "GDP", "BREAKEVEN_INFL", "OTHER"]
DEFAULT_IMPACT = ("OTHER", 0.40)


def text_or_empty(c: Column, width: int | None) -> Column:
    return head(strip(F.coalesce(c, F.lit(""))), width)


def given(name: str) -> Column:
    """Whether the payload has the field, be it null."""
    return F.coalesce(F.array_contains(F.json_object_keys("payload"), name), F.lit(False))


def parsed(raw: DataFrame, kind: str) -> DataFrame:
    """Rows of one type with the payload as struct `p`, read once per row.

    Tests on a plain column would be pushed below it and repeat the parsing; nothing is pushed below a
    generator.
    """
    rows = raw.where(F.col("type") == kind)
    return rows.select("*", F.explode(F.array(F.from_json("payload", PAYLOADS[kind]))).alias("p"))


def market(raw: DataFrame) -> DataFrame:
    """Quotes: bid and ask default to mid; mid is recomputed from them; volume is at least zero, and zero if blank.

    A price that is there but null or unreadable leaves the middle null, which rejects the row.
    """
    def price_of(name: str, default: Column) -> Column:
        value = F.col(f"p.{name}")
        return F.when(value.isNull() & ~given(name), default).otherwise(value.try_cast("double"))

    rows = parsed(raw, "market").withColumn("_mid", price_of("mid", d(0)))
    volume = F.coalesce(F.nullif(F.col("p.volume"), F.lit("")), F.lit("0")).try_cast("double")
    rows = rows.withColumns({"_bid": price_of("bid", F.col("_mid")), "_ask": price_of("ask", F.col("_mid")), "_vol": volume})
    return rows.select(
        *_head(raw),
        F.coalesce(F.col("p.symbol"), F.lit("XAU/USD")).alias("symbol"),
        F.round("_bid", 5).alias("bid"), F.round("_ask", 5).alias("ask"),
        F.when(F.col("_mid").isNotNull(), F.round((F.col("_bid") + F.col("_ask")) / 2, 5)).alias("mid"),
        F.round(F.col("_ask") - F.col("_bid"), 5).alias("spread"),
        F.when(F.col("_vol").isNotNull(), F.greatest(F.col("_vol"), d(0))).alias("volume"),
        F.coalesce(F.col("p.exchange"), F.lit("")).alias("exchange"))


def news(raw: DataFrame, title_width: int | None = None, text_width: int | None = None) -> DataFrame:
    """News events: whole titles and texts unless widths are given; a blank text is title and description."""
    rows = parsed(raw, "news")
    title, desc = text_or_empty(F.col("p.title"), title_width), text_or_empty(F.col("p.description"), text_width)
    body = F.coalesce(F.nullif(F.col("p.text"), F.lit("")), F.concat(title, F.lit(" "), desc))
    empty = F.lit("")
    return rows.select(
        *_head(raw), title.alias("title"), head(strip(body), text_width).alias("text"),
        F.coalesce("p.source", empty).alias("news_source"), F.coalesce("p.url", empty).alias("url"),
        F.coalesce("p.author", empty).alias("author"))


def sentiment(raw: DataFrame, title_width: int | None = None, text_width: int | None = None) -> DataFrame:
    """Posts: title and text joined, whole unless widths are given."""
    rows = parsed(raw, "sentiment")
    title, body = text_or_empty(F.col("p.title"), title_width), text_or_empty(F.col("p.text"), text_width)

    def counter(name: str) -> Column:
        value = F.col(f"p.{name}")
        return F.when(value.isNull() | (value == ""), F.lit(0)).otherwise(value.try_cast("long")).alias(name)

    return rows.select(
        *_head(raw), head(strip(F.concat(title, F.lit(" "), body)), text_width).alias("text"),
        counter("score"), F.coalesce("p.subreddit", F.lit("")).alias("subreddit"),
        counter("likes"), counter("retweets"))


def macro(raw: DataFrame) -> DataFrame:
    rows = parsed(raw, "macro")
    empty = F.lit("")
    return rows.select(
        *_head(raw), F.coalesce("p.series_id", "p.event", empty).alias("series_id"),
        F.coalesce("p.event", empty).alias("event"), F.upper(F.coalesce("p.country", empty)).alias("country"),
        F.col("p.value").try_cast("double").alias("value"), F.col("p.surprise").try_cast("double").alias("surprise"),
        F.coalesce("p.impact", F.lit("medium")).alias("impact"),
        F.coalesce("p.title", empty).alias("title"), F.coalesce("p.units", empty).alias("units"))


NORMALIZERS = {"market": market, "news": news, "sentiment": sentiment, "macro": macro}
# Fields that must have parsed for the row to count as good.
REQUIRED = {"market": ["bid", "ask", "mid", "volume"], "news": [], "sentiment": ["score", "likes", "retweets"],
            "macro": []}


def _head(raw: DataFrame) -> list[Column]:
    own = [F.timestamp_seconds("timestamp").alias("ts"), F.col("source"), F.col("confidence")]
    ids = [F.col(c) for c in raw.columns if c not in ("timestamp", "type", "payload", "source", "confidence")]
    return ids + own


def route(raw: DataFrame) -> dict[str, DataFrame]:
    """Typed frames of good rows plus `rejected`: unknown types and payloads that do not parse."""
    out: dict[str, DataFrame] = {}
    for kind, fn in NORMALIZERS.items():
        good = fn(raw)
        for c in REQUIRED[kind]:
            good = good.where(F.col(c).isNotNull())
        out[kind] = good
    out["rejected"] = raw.where(~is_good(raw))
    return out


def is_good(raw: DataFrame) -> Column:
    """The negation of rejection, as one expression over the raw row."""
    known = F.col("type").isin(*TYPES)

    def field(name: str) -> Column:
        return F.get_json_object("payload", f"$.{name}")

    def reads(name: str, kind: str, blank_ok: bool = False) -> Column:
        v = field(name)
        ok = v.isNull() | v.try_cast(kind).isNotNull()
        return ok | (v == "") if blank_ok else ok

    def is_price(name: str) -> Column:
        return reads(name, "double") & (field(name).isNotNull() | ~given(name))

    market_ok = is_price("mid") & is_price("bid") & is_price("ask") & reads("volume", "double", True)
    sentiment_ok = reads("score", "long", True) & reads("likes", "long", True) & reads("retweets", "long", True)
    return F.coalesce(known & (
        F.when(F.col("type") == "market", market_ok).when(F.col("type") == "sentiment", sentiment_ok)
        .otherwise(F.lit(True))), F.lit(False))


def price(df: DataFrame) -> Column:
    """mid unless it is zero or missing, else close."""
    close = F.col("close") if "close" in df.columns else F.lit(None).cast("double")
    return F.coalesce(F.nullif(F.col("mid"), d(0)), close)


def is_market(kind: Column) -> Column:
    return kind == "market"


def is_text(kind: Column) -> Column:
    return kind.isin("news", "sentiment")


def usable_text(df: DataFrame, min_chars: int = 10) -> DataFrame:
    """Rows whose text (or title) has at least `min_chars` characters after trimming; adds `body`."""
    blank = F.lit("")
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    body = strip(F.coalesce(F.nullif(F.col("text"), blank), title, blank))
    return df.withColumn("body", body).where(F.length("body") >= min_chars)


def series_category(df: DataFrame, series: str = "series_id") -> DataFrame:
    """Category and impact of a macro series from the fixed table; unknown series get the default."""
    category, impact = F.lit(DEFAULT_IMPACT[0]), d(DEFAULT_IMPACT[1])
    for sid, (name, weight) in SERIES_IMPACT.items():
        hit = F.col(series) == sid
        category = F.when(hit, name).otherwise(category)
        impact = F.when(hit, d(min(1.0, weight))).otherwise(impact)
    return df.withColumns({"event_type": category, "impact_score": impact})


def causal_node(series: Column) -> Column:
    """The causal series a macro observation feeds, by substring; null if none."""
    has = lambda *names: _any(series.contains(n) for n in names)
    return (F.when(has("DGS10", "DGS2"), "YIELDS").when(has("DTWEXBGS", "USD"), "DXY")
            .when(has("VIXCLS"), "VIX").when(has("DCOILWTICO"), "OIL").when(has("FEDFUNDS"), "FED")
            .when(has("CPIAUCSL", "T10YIE"), "INFLATION"))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def macro_vector(surprise: Column = None) -> Column:
    """12-way category one-hot, impact, surprise (zero if unknown)."""
    from tidemark.functions.vectors import one_hot

    s = F.coalesce(F.col("surprise") if surprise is None else surprise, d(0))
    return F.concat(one_hot(F.col("event_type"), CATEGORIES), F.array(F.col("impact_score"), s))


def text_vector() -> Column:
    """Sentiment, four emotions, embedding in one array."""
    return F.concat(F.array("sentiment_score"), F.col("emotion_vector"),
                    F.transform("topic_embedding", lambda x: x.cast("double")))
