"""Predictions through their life: settlement against realised prices, recent skill, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import d, pinball
from tidemark.operators.align import first_on_or_after


def pending_predictions(predictions: DataFrame, outcomes: DataFrame, today: str, at: str = "ts") -> DataFrame:
    """Predictions without an outcome whose horizon in calendar days has elapsed."""
    done = outcomes.select(F.col("prediction_id").alias("id"))
    due = F.date_add(F.to_date(at), F.col("horizon_d"))
    return (predictions.withColumn("settle_date", due).where(F.col("settle_date") <= F.lit(today).cast("date"))
            .join(done, "id", "left_anti"))


def settle(predictions: DataFrame, outcomes: DataFrame, prices: DataFrame, today: str, at: str = "ts",
           symbol: str | None = "GC=F") -> DataFrame:
    """Outcome rows of all due predictions: the first close on or after the settlement date.

    Predictions carry a symbol column, or all belong to `symbol`. Without a usable price: no row.
    """
    rows = pending_predictions(predictions, outcomes, today, at)
    if "symbol" not in rows.columns:
        rows = rows.withColumn("symbol", F.lit(symbol))
        prices = prices.where(F.col("symbol") == symbol)
    hit = first_on_or_after(rows, prices.select("symbol", "date", "close"), "settle_date")
    good = hit.where((F.col("close") > 0) & (F.col("ref_price") > 0))
    ret = F.log(F.col("close") / F.col("ref_price"))
    return good.select(
        F.col("id").alias("prediction_id"),
        (F.col("settle_date").cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("settled_at"),
        F.col("close").alias("realised_price"), ret.alias("realised_logret"),
        pinball(ret, F.col("q50"), 0.5).alias("pinball_loss"))


def recent_skill(predictions: DataFrame, outcomes: DataFrame, horizon_d: int, since: str,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Count, hit rate and mean pinball loss of predictions settled since a time."""
    o = outcomes.where(F.col("settled_at") >= F.lit(since).cast("timestamp")).select("prediction_id", "realised_logret")
    p = predictions.where(F.col("horizon_d") == horizon_d)
    j = p.join(o, p["id"] == o["prediction_id"])
    y, q = F.col("realised_logret"), F.col("q50")
    return j.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.signum(y) == F.signum(q)).cast("int")), 3).alias("hit_rate"),
        F.round(F.avg(pinball(y, q, 0.5)), 5).alias("mean_pinball_q50"))


def prediction_rows(scored: DataFrame, model_version: str, horizon_d: int) -> DataFrame:
    """Scored panel rows to rows of the predictions table, stamped 16:00 of their day."""
    context = F.to_json(F.struct("mu", "log_var", "sigma", "conformal_scale"))
    return scored.select(
        F.expr("replace(uuid(), '-', '')").alias("id"),
        (F.col("date").cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("ts"),
        F.lit(model_version).alias("model_version"), F.lit(horizon_d).alias("horizon_d"),
        F.col("gold_close").alias("ref_price"), "q10", "q25", "q50", "q75", "q90",
        F.lit(None).cast("string").alias("regime"), "confidence", context.alias("context_json"))


def write_predictions(lake, rows: DataFrame, dry_run: bool = False) -> DataFrame:
    """Store predictions; a dry run only returns them."""
    if not dry_run:
        lake.upsert("predictions", rows)
    return rows


def promote(candidates: DataFrame, registry: DataFrame, margin: float = 0.05) -> DataFrame:
    """Decide per horizon whether a candidate replaces the active model.

    Metrics are sharpe_nonoverlap, sharpe_nw, sharpe_med, sharpe_lo (all may be null) and has_metrics.
    The conservative ratio is the first of the three that is known. Both frames are small and keyed
    by horizon.
    """
    lowest = d(float("-inf"))

    def conservative(prefix: str):
        return F.coalesce(*[F.col(f"{prefix}.{c}") for c in ("sharpe_nonoverlap", "sharpe_nw", "sharpe_med")], lowest)

    j = candidates.alias("c").join(registry.alias("r"), F.col("c.horizon") == F.col("r.horizon"), "left")
    # A lower bound of zero counts as unknown, as the rule has it.
    lo = F.coalesce(F.nullif(F.col("c.sharpe_lo"), d(0)), lowest)
    absent = F.col("r.horizon").isNull()
    cold = absent | ~F.coalesce(F.col("r.has_metrics"), F.lit(False))
    cold_ok = (lo > -0.25) & (conservative("c") > -0.10)
    better = (lo > 0) & (conservative("c") > conservative("r") + margin)
    verdict = (F.when(~F.col("c.has_metrics"), absent).when(cold, cold_ok).otherwise(better))
    return j.select(F.col("c.horizon").alias("horizon"), F.col("c.path").alias("path"),
                    verdict.alias("promoted"), conservative("c").alias("conservative_sharpe"))
