"""Purged walk-forward evaluation.

Rows are days of one series, numbered from zero; fold k tests rows [train + k*test, train + (k+1)*test)
and trains on all rows at least embargo + horizon before them. Membership is arithmetic on the row
number, so no fold table is joined. A series has one row per day, which bounds its windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import d
from tidemark.operators import metrics as M
from tidemark.operators.robust import quantiles


@dataclass(frozen=True)
class Walk:
    train: int = 252 * 8
    test: int = 63
    embargo: int = 5
    horizon: int = 20

    @property
    def gap(self) -> int:
        return self.embargo + self.horizon

    @property
    def first(self) -> int:
        """First block whose training part is not empty; folds are counted from it."""
        return 0 if self.train > self.gap else (self.gap - self.train) // self.test + 1


def number_days(df: DataFrame, label: str, by: list[str], at: str = "date") -> DataFrame:
    """Labelled rows with their position `i` and the series length `n`."""
    group = Window.partitionBy(*by, F.lit(0))
    return (df.where(F.col(label).isNotNull())
            .withColumn("i", F.row_number().over(group.orderBy(at)) - 1)
            .withColumn("n", F.count("*").over(group)))


def folds(lengths: DataFrame, walk: Walk, by: list[str] = ()) -> DataFrame:
    """Fold boundaries for series of given length `n`: fold, train_end, test_start, test_end (exclusive)."""
    last = F.floor((F.col("n") - walk.train) / walk.test) - 1
    blocks = lengths.where(last >= walk.first).select(
        *by, F.explode(F.sequence(F.lit(walk.first).cast("long"), last)).alias("k"))
    start = F.col("k") * walk.test + walk.train
    return blocks.select(*by, (F.col("k") - walk.first).alias("fold"), (start - walk.gap).alias("train_end"),
                         start.alias("test_start"), (start + walk.test).alias("test_end"))


def test_rows(numbered: DataFrame, walk: Walk) -> DataFrame:
    """Rows of complete test blocks with their fold."""
    k = F.floor((F.col("i") - walk.train) / walk.test)
    complete = (k + 1) * walk.test + walk.train <= F.col("n")
    return (numbered.withColumn("_k", k).where((F.col("i") >= walk.train) & complete & (F.col("_k") >= walk.first))
            .withColumn("fold", F.col("_k") - walk.first).drop("_k"))


def train_rows(numbered: DataFrame, walk: Walk) -> DataFrame:
    """Each row once per fold that trains on it."""
    last = F.floor((F.col("n") - walk.train) / walk.test) - 1
    # The first block whose training part ends after this row.
    lo = F.greatest(F.floor((F.col("i") + walk.gap - walk.train) / walk.test) + 1, F.lit(walk.first).cast("long"))
    return (numbered.where(lo <= last).withColumn("_k", F.explode(F.sequence(lo, last)))
            .withColumn("fold", F.col("_k") - walk.first).drop("_k"))


def trades(test: DataFrame, thresholds: DataFrame | float, by: list[str], y: str, p: str, cost_bps: float = 1.0
           ) -> DataFrame:
    """Positions, costs and returns of the test rows: sign of the forecast unless it is below threshold."""
    if isinstance(thresholds, DataFrame):
        rows = test.join(thresholds, [*by, "fold"])
    else:
        rows = test.withColumn("threshold", d(thresholds))
    pos = F.when(F.abs(p) < F.col("threshold"), d(0)).otherwise(F.signum(p))
    w = Window.partitionBy(*by, "fold").orderBy("i")
    rows = rows.withColumn("pos", pos)
    turn = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), d(0)))
    return rows.withColumn("ret", F.col("pos") * F.col(y) - turn * (cost_bps * 1e-4))


def train_thresholds(train: DataFrame, by: list[str], p: str, percentile: float = 30.0) -> DataFrame:
    """Per fold the no-trade threshold: a percentile of absolute forecasts on the training rows."""
    sizes = train.select(*by, "fold", F.abs(F.col(p)).alias("_size"))
    return quantiles(sizes, ["_size"], [percentile / 100.0], [*by, "fold"]).select(
        *by, "fold", F.get("_size", 0).alias("threshold"))


def fold_metrics(rows: DataFrame, by: list[str], y: str, p: str, horizon: int, at: str = "date",
                 band: tuple[str, str] | None = None) -> DataFrame:
    traded = F.col("pos") != 0
    cols = [
        F.min(at).alias("test_start"), F.max(at).alias("test_end"), F.count("*").alias("n_test"),
        M.hit_rate(F.when(traded, F.col(y)), F.when(traded, F.col(p))).alias("hit_rate"),
        M.mean_pinball(F.col(y), F.col(p), 0.5).alias("pinball_q50"), M.sharpe(F.col("ret")).alias("sharpe")]
    if band:
        cols.append(M.coverage(F.col(y), F.col(band[0]), F.col(band[1])).alias("coverage_80"))
    keys = [*by, "fold"]
    return rows.groupBy(*keys).agg(*cols).join(
        M.newey_west_sharpe(rows, "ret", "i", keys, lag=horizon), keys)


def overall(rows: DataFrame, per_fold: DataFrame, by: list[str], horizon: int, n_boot: int = 0) -> DataFrame:
    """Mean fold metrics and Sharpe ratios of all test returns in order."""
    out = per_fold.groupBy(*by).agg(
        F.count("*").alias("n_folds"), F.avg("hit_rate").alias("overall_hit"), F.avg("pinball_q50").alias("overall_pin"))
    parts = [M.newey_west_sharpe(rows, "ret", "i", by, lag=horizon),
             M.nonoverlap_sharpe(rows, "ret", "i", horizon, by)]
    if n_boot:
        parts.append(M.bootstrap_sharpe(rows, "ret", "i", by, n_boot))
    for part in parts:
        out = out.join(part, by) if by else out.crossJoin(part)
    return out


def run(df: DataFrame, label: str, walk: Walk, by: list[str], predictor: Column | Callable[[DataFrame, DataFrame], DataFrame],
        cost_bps: float = 1.0, threshold: float | None = None, percentile: float = 30.0, at: str = "date") -> DataFrame:
    """Trades of a walk-forward backtest.

    predictor: a column expression (no fitting), or a function (train, test) -> rows of both with a
    column `pred`; it gets all folds at once, keyed by `fold`, and a flag `is_test`.
    """
    numbered = number_days(df, label, by, at)
    test, train = test_rows(numbered, walk), train_rows(numbered, walk)
    if isinstance(predictor, Column):
        test, train = test.withColumn("pred", predictor), train.withColumn("pred", predictor)
    else:
        both = predictor(train.withColumn("is_test", F.lit(False)), test.withColumn("is_test", F.lit(True)))
        test, train = both.where("is_test"), both.where("NOT is_test")
    limits = threshold if threshold is not None else train_thresholds(train, by, "pred", percentile)
    return trades(test, limits, by, label, "pred", cost_bps)


def per_fold(fit_predict: Callable, features: list[str], label: str, by: list[str]):
    """Wrap fit_predict(X_train, y_train, X) -> predictions (numpy) as a predictor for `run`.

    One group per series and fold: at most the days of one series, so it fits a task.
    """
    def predictor(train: DataFrame, test: DataFrame) -> DataFrame:
        rows = train.unionByName(test).fillna(0.0, subset=features)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", pred double"

        def apply(pdf):
            fit = pdf[~pdf["is_test"]]
            pred = fit_predict(fit[features].to_numpy(), fit[label].to_numpy(), pdf[features].to_numpy())
            return pdf.assign(pred=pred)

        return rows.groupBy(*by, "fold").applyInPandas(apply, schema)

    return predictor
