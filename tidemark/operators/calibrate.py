"""Forecast bands, conformal scaling and rolling residual quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import QUANTILES, Z10, Z25, clip, d
from tidemark.operators.blocks import index_rows, running
from tidemark.operators.robust import quantiles
from tidemark.operators.rolling import map_blocks, rolling_quantiles

# Distances between neighbouring quantiles of the standard Normal, from q25-q10 outwards in order:
# (q25 - q10), (q50 - q25), (q75 - q50), (q90 - q75).
WIDTHS = (Z10 - Z25, Z25, Z25, Z10 - Z25)
NORMAL_Z = (-Z10, -Z25, 0.0, Z25, Z10)
BAND = ["q10", "q25", "q50", "q75", "q90"]


def band(mu: Column, sigma: Column, scale: Column | float = 1.0, widths: tuple[float, ...] = WIDTHS) -> dict[str, Column]:
    """Five quantiles from location, spread, conformal scale and the four widths."""
    z = [-(widths[0] + widths[1]), -widths[1], 0.0, widths[2], widths[2] + widths[3]]
    s = sigma * scale
    return {name: mu + s * v for name, v in zip(BAND, z)}


def price_band(price: Column, mu: Column, residuals: Column) -> Column:
    """Log-return residual quantiles (array) to an ascending array of prices."""
    return F.array_sort(F.transform(residuals, lambda q: price * F.exp(mu + q)))


def monotone(q: Column) -> Column:
    """Running maximum over an array of quantiles."""
    return F.transform(q, lambda _x, i: F.array_max(F.slice(q, F.lit(1), i + 1)))


def confidence(log_var: Column) -> Column:
    return clip(F.exp(-0.5 * log_var), 0.05, 0.99)


def conformal_scale(df: DataFrame, y: str, mu: str, sigma: str, widths: tuple[float, ...] = WIDTHS,
                    target: float = 0.80, previous: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Factor on sigma that gives the outer band its nominal coverage; `previous` below 10 rows."""
    z = F.abs((F.col(y) - F.col(mu)) / (F.col(sigma) + 1e-8))
    half = max(widths[0] + widths[1], 1e-6)
    rows = df.select(*by, z.alias("_z"))
    counts = rows.groupBy(*by).agg(F.count("_z").alias("_n"))
    wanted = quantiles(rows, ["_z"], [target], by)
    both = counts.join(wanted, list(by)) if by else counts.crossJoin(F.broadcast(wanted))
    scale = clip(F.get("_z", 0) / half, 0.5, 5.0)
    return both.select(*by, F.when(F.col("_n") >= 10, scale).otherwise(d(previous)).alias("conformal_scale"))


def rolling_residual_quantiles(df: DataFrame, residual: str, sigma: str, horizon: int, order, rows: int = 512,
                               cold: int = 16, size: int = 16384) -> DataFrame:
    """Residual band per tick: quantiles of the last `rows` known standardised residuals, Normal ones while cold.

    Expects numbered rows (`rn`). `residual` stands at the row where it became known, that of a forecast made `horizon`
    ticks before, and is null where none did; pending rows take up no place in the window. Each row has the band of all
    residuals known by then, its own included, and `n_residuals`, how many of them the window holds.
    """
    outputs = ("n_residuals", *[f"_{q}" for q in BAND])

    def block(x, _rn):
        known, quantiles = rolling_quantiles(x, rows, QUANTILES)
        return {"n_residuals": known, **{f"_{name}": quantiles[:, i] for i, name in enumerate(BAND)}}

    known = index_rows(df.where(F.col(residual).isNotNull()).withColumnRenamed("rn", "_at"), order)
    bands = map_blocks(known, order.keys, residual, block, outputs, size, rows).select(
        *[F.col(k).alias(f"_of_{k}") for k in order.keys], "_at", F.struct(*outputs).alias("_band"))
    same = F.col("rn") == F.col("_at")
    for k in order.keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = running(df.join(bands, same, "left").drop("_at", *[f"_of_{k}" for k in order.keys]), order,
                  {"_now": ("last", F.col("_band"))})
    out = out.select(*df.columns, F.coalesce("_now.n_residuals", d(0)).alias("n_residuals"),
                     *[F.col(f"_now._{q}").alias(f"_{q}") for q in BAND])
    s = F.col(sigma) * (horizon ** 0.5)
    warm = F.col("n_residuals") >= cold
    out = out.withColumns({f"resid_{name}": F.when(warm, F.col(f"_{name}")).otherwise(d(z)) * s
                           for name, z in zip(BAND, NORMAL_Z)})
    return out.drop(*[f"_{q}" for q in BAND])


def residual_sigma(sq_error: Column, eps: float = 1e-8) -> Column:
    """Target of the spread model: log of the squared residual."""
    return F.log(sq_error + eps)
