"""The daily dossier: market snapshot, headlines, analogues, skill and forecast in one record and one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT = ["gold_close", "tips_10y", "dxy_close", "vix_close", "cot_mm_net_z", "gld_flow_5d_z"]
HEADLINES, ANALOGUES = 8, 5  # what the text shows


def build_dossier(panel_row: DataFrame, headlines: DataFrame, analogues: DataFrame, skill: DataFrame,
                  forecast: DataFrame | None = None, regime: str | None = None) -> DataFrame:
    """Join one-row parts. headlines: rank, title, gold_impact, confidence, event_type of the day (at most 8);
    analogues: date, similarity, target_logret (at most k); both are short lists by construction."""
    out = panel_row.select("date", *[F.col(c) for c in SNAPSHOT], F.lit(regime).cast("string").alias("regime"))
    news = headlines.agg(F.array_sort(F.collect_list(F.struct(
        "rank", "title", "gold_impact", "confidence", "event_type"))).alias("top_news"))
    past = analogues.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("similarity")).alias("order"), F.col("date").alias("day"), "similarity",
        F.col("target_logret").alias("outcome")))).alias("analogues"))
    facts = skill.select(F.struct("n", "hit_rate", "mean_pinball_q50").alias("recent_skill"))
    for part in (news, past, facts):
        out = out.crossJoin(F.broadcast(part))
    if forecast is not None:
        q = forecast.select(F.struct("q10", "q25", "q50", "q75", "q90").alias("model_q"), "lambda")
        out = out.crossJoin(F.broadcast(q))
    return out


def _number(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("None"))


def dossier_text(dossier: DataFrame) -> DataFrame:
    """Plain-text rendering, one text per dossier row."""
    line = F.concat
    lit = F.lit
    news = F.transform(F.slice("top_news", 1, HEADLINES), lambda n: F.format_string(
        "  - [%s] impact=%+.2f conf=%.2f: %s", F.coalesce(n["event_type"], lit("?")), n["gold_impact"], n["confidence"],
        F.substring(F.coalesce(n["title"], lit("")), 1, 140)))
    past = F.transform(F.slice("analogues", 1, ANALOGUES), lambda a: F.format_string(
        "  - %s sim=%.2f → realised log-ret over horizon = %+.4f", a["day"].cast("string"), a["similarity"], a["outcome"]))
    quantiles = F.to_json("model_q") if "model_q" in dossier.columns else lit("{}")
    trust = _number("lambda") if "lambda" in dossier.columns else lit("None")
    lines = [
        line(lit("DATE: "), F.col("date").cast("string")),
        line(lit("SPOT: "), _number("gold_close")),
        line(lit("TIPS_10Y: "), _number("tips_10y"), lit(" | DXY: "), _number("dxy_close"), lit(" | VIX: "),
             _number("vix_close")),
        line(lit("COT_MM_NET_Z: "), _number("cot_mm_net_z"), lit(" | GLD_FLOW_5D_Z: "), _number("gld_flow_5d_z")),
        line(lit("REGIME: "), _number("regime")),
        line(lit("MODEL_QUANTILES (h-day log-ret): "), quantiles),
        line(lit("MODEL_LAMBDA (residual trust): "), trust),
        lit(""), lit("TOP_NEWS_TODAY:"), F.array_join(news, "\n"),
        lit(""), lit("HISTORICAL_ANALOGUES (top-k similar regimes):"), F.array_join(past, "\n"),
        lit(""), line(lit("RECENT_MODEL_SKILL (last 30d): "), F.to_json("recent_skill")),
    ]
    return dossier.withColumn("text", F.concat_ws("\n", *lines))


THESIS = ("thesis string, confidence double, direction string, horizon_days int, primary_driver string, "
          "trade_idea string, key_evidence array<string>, risks array<string>, falsifiable array<string>")


def thesis_rows(replies: DataFrame, model: str) -> DataFrame:
    """Rows of the theses table from reply objects (date, reply): six fields and the tests packed as JSON."""
    m = replies.withColumn("m", F.from_json("reply", THESIS)).where(F.col("m.thesis").isNotNull())
    packed = F.to_json(F.struct(*[f"m.{c}" for c in ("direction", "horizon_days", "primary_driver", "trade_idea",
                                                     "key_evidence", "risks")]))
    return m.select("date", F.lit(model).alias("model"), F.col("m.thesis").alias("thesis"),
                    F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), packed.alias("predictions"),
                    F.to_json(F.coalesce("m.falsifiable", F.array().cast("array<string>"))).alias("falsifiable"),
                    F.lit(None).cast("double").alias("brier_score"))
