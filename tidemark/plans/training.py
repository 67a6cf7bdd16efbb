"""Fit, calibrate and apply the forecaster on panel rows.

The forecast is a linear structural part on seven named drivers plus lambda times a residual part on
all features, with a spread model and a conformal factor. Scaler, winsoriser and models are fitted on
the earlier part of the rows, lambda and the conformal factor on the later part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import QUANTILES, clip, d, mixed, pinball
from tidemark.functions.vectors import linear_score
from tidemark.operators import calibrate, robust

# Structural drivers and the prior weight of each.
STRUCT_PRIOR = {
    "tips_d1_bp": -0.0010,
    "dxy_logret_1d": -0.40,
    "gld_flow_5d_z": 0.015,
    "cot_mm_net_z": -0.010,
    "news_impact": 0.020,
    "vix_logret_1d": 0.040,
    "real_yield_proxy": -0.0020,
}
LAMBDA_GRID = (0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)


def chronological_split(df: DataFrame, by: list[str] = (), at: str = "date", val_frac: float = 0.15) -> DataFrame:
    """Mark the last share of each series' rows; a series has one row per date."""
    group = Window.partitionBy(*by, F.lit(0))
    n = F.count("*").over(group)
    cut = F.greatest(F.lit(1), F.floor(n * d(1 - val_frac)))
    return df.withColumn("is_val", F.row_number().over(group.orderBy(at)) > cut)


def fit_quantiles(df: DataFrame, features: list[str], label: str, taus: tuple[float, ...] = QUANTILES,
                  start: dict[str, float] | None = None, ridge: float = 1e-5, steps: int = 16
                  ) -> dict[float, np.ndarray]:
    """Linear quantile regression for several levels at once: weights with the intercept last.

    From the least-squares fit (of what `start` leaves) and the quantiles of its residuals, Newton steps minimise the
    check loss smoothed by a logistic kernel, which narrows from the size of the residuals to a fraction of it. A step
    is one pass over the rows for all levels: partitions give gradients, Gram sums weighted by the kernel and the
    unsmoothed loss, whose size depends on the features only. Where a step raises a level's loss by a tenth it is halved
    towards the best weights so far, and these are returned. Null features count as zero, rows without a label are left
    out; without any row all weights are those of `start`, or zero.
    """
    names, levels, p = list(features), np.array(taus), len(features) + 1
    given = np.array([*[(start or {}).get(c, 0.0) for c in names], 0.0])
    rows = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), d(0)) for c in names], d(1)).alias("x"),
                     F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull()).persist()
    try:
        sums = _sums(rows, lambda x, y: np.append(x.T @ np.column_stack([x, y - x @ given]), len(y)), p * (p + 1) + 1)
        n, gram = sums[-1], sums[:-1].reshape(p, p + 1)
        if not n:
            return {t: given.copy() for t in taus}
        first = given + np.linalg.lstsq(gram[:, :-1], gram[:, -1], rcond=None)[0]
        rest = F.col("y") - sum((F.get("x", i) * d(float(w)) for i, w in enumerate(first)), d(0))
        middle = rows.agg(F.percentile_approx(rest, list(taus), 10_000)).first()[0]
        weights = np.tile(first, (len(taus), 1))
        weights[:, -1] += middle
        penalty = np.append(np.full(p - 1, ridge), 0.0)
        best, best_loss, good = weights.copy(), np.full(len(taus), np.inf), np.zeros(len(taus))
        size = _sums(rows, lambda x, y: _losses(x, y, weights, levels), len(taus)) / n
        for _ in range(steps):
            width = np.maximum(size / (levels * (1 - levels)), 1e-12) * np.maximum(0.5 ** good, 0.005)
            sums = _sums(rows, lambda x, y: _newton_sums(x, y, weights, levels, width), len(taus) * (p * (p + 1) + 1))
            size, sums = sums[:len(taus)] / n, sums[len(taus):].reshape(len(taus), p, p + 1) / n
            loss = size + 0.5 * (penalty * weights ** 2).sum(axis=1)
            for j in range(len(taus)):
                if loss[j] > 1.1 * best_loss[j]:
                    weights[j] = 0.5 * (weights[j] + best[j])
                    continue
                if loss[j] < best_loss[j]:
                    best[j], best_loss[j] = weights[j], loss[j]
                good[j] += 1
                curve = sums[j, :, :-1] + np.diag(penalty)
                curve += np.eye(p) * 1e-9 * np.trace(curve) / p
                weights[j] = weights[j] - np.linalg.lstsq(curve, sums[j, :, -1] + penalty * weights[j], rcond=None)[0]
        return dict(zip(taus, best))
    finally:
        rows.unpersist()


def _sums(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of a vector that `part` makes from each batch's x and y."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += part(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy())
        yield pd.DataFrame({"i": np.arange(size), "s": total})

    added = rows.mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    entries = added.agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("all")).first()["all"]
    return np.array([e["s"] for e in entries]) if entries else np.zeros(size)


def _losses(x: np.ndarray, y: np.ndarray, weights: np.ndarray, levels: np.ndarray) -> np.ndarray:
    err = y[:, None] - x @ weights.T
    return np.maximum(levels * err, (levels - 1) * err).sum(axis=0)


def _newton_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, levels: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Losses, then for each level the curvature of the smoothed loss with its gradient as last column."""
    out = [_losses(x, y, weights, levels)]
    for w, tau, h in zip(weights, levels, width):
        below = 0.5 - 0.5 * np.tanh((y - x @ w) / (2 * h))
        out.append((x.T @ np.column_stack([x * (below * (1 - below) / h)[:, None], below - tau])).ravel())
    return np.concatenate(out)


@dataclass
class Forecaster:
    """Everything needed to score panel rows; the fits are small frames, one row per feature."""

    features: list[str]
    struct: dict[str, float]
    intercept: float
    winsor: DataFrame
    scaler: DataFrame
    residual: object = None
    spread: object = None
    lam: float = 0.0
    conformal: float = 1.0
    widths: tuple[float, ...] = field(default=calibrate.WIDTHS)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Nulls to zero, winsorise, scale - the same steps for training, validation and scoring."""
        cut = robust.apply_winsor(df, self.features, self.winsor)
        return robust.apply_scaler(cut, self.features, self.scaler)

    def components(self, prepared: DataFrame) -> DataFrame:
        out = prepared.withColumn("mu_struct", linear_score(self.struct, self.intercept))
        if self.residual is None:
            return out.withColumns({"mu_resid": d(0), "log_var": F.log(d(1e-4))})
        vec = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(out)
        vec = self.residual.transform(vec).withColumnRenamed("prediction", "mu_resid")
        if self.spread is None:
            return vec.withColumn("log_var", F.log(d(1e-4))).drop("_x")
        return self.spread.transform(vec).withColumnRenamed("prediction", "log_var").drop("_x")

    def score(self, df: DataFrame, keep: tuple[str, ...] = ("date", "gold_close")) -> DataFrame:
        """mu, sigma, five quantiles and confidence for every row."""
        kept = [c for c in keep if c in df.columns]
        rows = df.withColumns({f"_k_{c}": F.col(c) for c in kept})
        out = self.components(self.prepare(rows))
        mu = F.col("mu_struct") + d(self.lam) * F.col("mu_resid")
        out = out.withColumns({"mu": mu, "sigma": clip(F.exp(0.5 * F.col("log_var")), 1e-6, 0.5),
                               "conformal_scale": d(self.conformal)})
        q = calibrate.band(F.col("mu"), F.col("sigma"), F.col("conformal_scale"), self.widths)
        return out.select(*[F.col(f"_k_{c}").alias(c) for c in kept], "mu", "mu_struct", "mu_resid", "log_var", "sigma",
                          "conformal_scale", *[c.alias(n) for n, c in q.items()],
                          calibrate.confidence(F.col("log_var")).alias("confidence"))


def train(panel: DataFrame, features: list[str], label: str, by: list[str] = (), val_frac: float = 0.15,
          steps: int = 16, trees: int = 10, depth: int = 3, seed: int = 0) -> Forecaster:
    """Fit a forecaster on labelled rows."""
    from tidemark.session import write_through

    struct = [c for c in STRUCT_PRIOR if c in features]
    rows = chronological_split(panel.where(F.col(label).isNotNull()), by, val_frac=val_frac)
    rows = write_through(rows.select("is_val", F.col(label).alias("_y"), *features), "training")
    early = rows.where(~F.col("is_val"))

    winsor = robust.fit_winsor(early, features)
    cut = robust.apply_winsor(early, features, winsor)
    scaler = robust.fit_scaler(cut, features)
    model = Forecaster(features, {}, 0.0, winsor, scaler)
    prepared = write_through(model.prepare(rows), "prepared")
    fit_rows, val_rows = prepared.where(~F.col("is_val")), prepared.where("is_val")

    w = fit_quantiles(fit_rows, struct, "_y", (0.5,), STRUCT_PRIOR, steps=steps)[0.5]
    model.struct, model.intercept = dict(zip(struct, w[:-1].tolist())), float(w[-1])

    assemble = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    left = fit_rows.withColumn("_r", F.col("_y") - linear_score(model.struct, model.intercept))
    model.residual = GBTRegressor(featuresCol="_x", labelCol="_r", maxIter=trees, maxDepth=depth, seed=seed).fit(
        assemble.transform(left))
    model.lam = best_lambda(model.components(val_rows), "_y")

    fitted = model.components(fit_rows)
    err = F.col("_y") - F.col("mu_struct") - d(model.lam) * F.col("mu_resid")
    target = fitted.drop("log_var").withColumn("_s", calibrate.residual_sigma(err * err))
    model.spread = LinearRegression(featuresCol="_x", labelCol="_s", regParam=0.01).fit(assemble.transform(target))

    val = model.components(val_rows).withColumns({
        "mu": F.col("mu_struct") + d(model.lam) * F.col("mu_resid"),
        "sigma": clip(F.exp(0.5 * F.col("log_var")), 1e-6, 0.5)})
    model.conformal = calibrate.conformal_scale(val, "_y", "mu", "sigma").first()[0]
    return model


def best_lambda(components: DataFrame, label: str, grid: tuple[float, ...] = LAMBDA_GRID) -> float:
    """Trust in the residual part with the smallest median loss; one pass for the whole grid."""
    y = F.col(label)
    losses = components.agg(*[
        F.avg(pinball(y, F.col("mu_struct") + d(g) * F.col("mu_resid"), 0.5)).alias(str(i))
        for i, g in enumerate(grid)]).first()
    return min((losses[i], g) for i, g in enumerate(grid) if losses[i] is not None)[1]


REGIME_CODES = ("TRENDING", "RANGING", "RISK-ON", "RISK-OFF")


def error_features(df: DataFrame, context: str = "context", regime: str = "regime", width: int = 32) -> DataFrame:
    """Context cut or padded to `width`, one-hot regime (unknown counts as the first)."""
    from pyspark.ml.functions import array_to_vector

    head = F.slice(F.concat(F.transform(context, lambda x: x.cast("double")), F.array_repeat(d(0), width)), 1, width)
    known = F.when(F.col(regime).isin(*REGIME_CODES), F.col(regime)).otherwise(REGIME_CODES[0])
    hot = F.array(*[F.when(known == r, d(1)).otherwise(d(0)) for r in REGIME_CODES])
    return df.withColumn("_x", array_to_vector(F.concat(head, hot)))


def newest(df: DataFrame, at: list[str], n: int, by: list[str] = (), parts: int = 64) -> DataFrame:
    """The n newest rows of each key by the columns `at`, which tell a key's rows apart.

    A key's rows are dealt to parts, each part keeps its n newest, then the key keeps n of these: however many rows a
    key has, no task orders more than a part of them, or `parts` times n.
    """
    salt = F.pmod(F.xxhash64(*at), F.lit(parts))
    order = [F.desc(c) for c in at]
    few = df.withColumn("_salt", salt).withColumn("_k", F.row_number().over(
        Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_k") <= n)
    last = Window.partitionBy(*by, F.lit(0)).orderBy(*order)
    return few.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= n).drop("_k", "_salt")


def replay_sample(errors: DataFrame, at: list[str], by: list[str] = (), n: int = 3000, recent: int = 10_000, seed: int = 0,
                  draw: Column | None = None) -> DataFrame:
    """Uniform sample without replacement of at most n of the newest errors of each key (this is the feature).

    The rows with the smallest hash of (seed, draw) stay; `draw` is a whole number that tells a key's rows apart, by
    default a hash of `at`. Equal hashes go by `at`.
    """
    number = F.xxhash64(*at) if draw is None else draw.cast("long")
    drawn = Window.partitionBy(*by, F.lit(0)).orderBy(mixed(number + seed * 7919), *at)  # over `recent` rows a key
    return newest(errors, at, recent, by).withColumn("_k", F.row_number().over(drawn)).where(F.col("_k") <= n).drop("_k")


def fit_error_model(errors: DataFrame, target: str = "abs_error", trees: int = 10, depth: int = 4, seed: int = 0):
    """Predict the absolute forecast error from context and regime."""
    return GBTRegressor(featuresCol="_x", labelCol=target, lossType="absolute", maxIter=trees, maxDepth=depth,
                        stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=8, seed=seed).fit(error_features(errors))


def raw_confidence(df: DataFrame, model, err_sd: float) -> DataFrame:
    """1 / (1 + exp(predicted error in sigmas - 1.5)), kept within [0.05, 0.99]."""
    out = model.transform(error_features(df)).withColumnRenamed("prediction", "predicted_error")
    z = F.col("predicted_error") / max(err_sd, 1e-9)
    return out.withColumn("raw_confidence", clip(1.0 / (1.0 + F.exp(z - 1.5)), 0.05, 0.99)).drop("_x")


def diagnostics(model: Forecaster, panel: DataFrame, label: str, recent_days: int = 60, repeats: int = 5
                ) -> dict[str, DataFrame]:
    """Permutation importance of the linear part on the late rows and drift of the last days against the rest."""
    from tidemark.operators.drift import ks_drift, permutation_importance

    rows = model.prepare(chronological_split(panel.where(F.col(label).isNotNull())))
    weights, b = model.struct, model.intercept
    importance = permutation_importance(
        rows.where("is_val"), list(weights), label,
        lambda x: sum((d(w) * x[f] for f, w in weights.items()), d(b)), "date", repeats)
    marked = panel.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("date"))))  # one row per date
    drift = ks_drift(marked.where(F.col("_k") > recent_days), marked.where(F.col("_k") <= recent_days), model.features)
    return {"importance": importance, "drift": drift}
