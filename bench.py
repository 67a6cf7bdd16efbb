"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "tick_returns_vol", "tick_oscillators", "tick_obv", "tick_macd", "tick_fracdiff", "tick_robust_z", "tick_vwap",
    "tick_horizon_returns", "logical_clock", "candles_60s", "dedup_first_seen", "feed_tick_messages", "normalize_market",
    "asof_last_tick", "fusion_latest_values", "kalman_confidence", "garch", "regime_sticky", "residual_quantiles",
    "panel_returns_labels", "panel_robust_z", "panel_yang_zhang", "panel_full", "news_daily_signal", "news_topk",
    "news_pending", "macro_surprise", "settle_predictions", "recent_skill", "upsert_prices", "memory_topk",
    "analogue_topk", "backtest_metrics", "backtest_overall", "scaler_fit", "ks_drift", "emotion_vector", "html_strip",
    "statement_word_changes", "granger",
]


def main() -> None:
    from tidemark import catalog
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    catalog.load_all()
    catalog.QUERIES["event_counts"](spark, sf_dir).collect()  # start the session before the clock
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
