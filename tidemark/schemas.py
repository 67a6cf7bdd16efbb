"""Explicit schemas: lake tables, raw events and the payloads of each event type."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
          "date": T.DateType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def _struct(text: str) -> T.StructType:
    """`name type, ...` to a StructType without needing a session."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "prices_d": _struct("date date, symbol string, open double, high double, low double, close double, "
                        "volume double, source string"),
    "macro_d": _struct("date date, series_id string, value double"),
    "cot_disagg": _struct(
        "report_date date, contract string, open_interest double, mm_long double, mm_short double, "
        "mm_spread double, swap_long double, swap_short double, producer_long double, producer_short double, "
        "other_rep_long double, other_rep_short double, nonrep_long double, nonrep_short double"),
    "etf_flows": _struct("date date, ticker string, holdings_tonnes double, shares_out double, nav double, "
                         "aum_usd double, flow_usd double"),
    "news": _struct("id string, ts timestamp, source string, url string, title string, text string, raw_json string"),
    "news_features": _struct(
        "news_id string, model_version string, extracted_at timestamp, event_type string, gold_impact double, "
        "confidence double, horizon_minutes int, novel boolean, surprise_signed double, rationale string"),
    "fomc_statements": _struct("date date, statement string, diff_prior string, embedding binary"),
    "predictions": _struct(
        "id string, ts timestamp, model_version string, horizon_d int, ref_price double, q10 double, q25 double, "
        "q50 double, q75 double, q90 double, regime string, confidence double, context_json string"),
    "outcomes": _struct("prediction_id string, settled_at timestamp, realised_price double, "
                        "realised_logret double, pinball_loss double"),
    "theses": _struct("date date, model string, thesis string, confidence double, predictions string, "
                      "falsifiable string, brier_score double"),
    "lake_runs": _struct("run_id string, started_at timestamp, finished_at timestamp, source string, "
                         "rows_added int, notes string"),
}

KEYS: dict[str, list[str]] = {
    "prices_d": ["date", "symbol"], "macro_d": ["date", "series_id"], "cot_disagg": ["report_date", "contract"],
    "etf_flows": ["date", "ticker"], "news": ["id"], "news_features": ["news_id", "model_version"],
    "fomc_statements": ["date"], "predictions": ["id"], "outcomes": ["prediction_id"], "theses": ["date"],
    "lake_runs": ["run_id"],
}

RAW_EVENT = _struct("timestamp double, type string, payload string, source string, confidence double")

# Payload fields are read as strings and cast one by one: a number that does not parse marks the row
# as bad instead of nulling the whole payload.
PAYLOADS: dict[str, T.StructType] = {
    "market": _struct("symbol string, mid string, bid string, ask string, volume string, exchange string"),
    "news": _struct("title string, description string, text string, source string, url string, author string"),
    "sentiment": _struct("title string, text string, score string, subreddit string, likes string, retweets string"),
    "macro": _struct("series_id string, event string, country string, value string, surprise string, "
                     "impact string, title string, units string"),
}
