"""Scalar helpers shared by the indicator, panel and scoring code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_YEAR = 252.0 ** 0.5
MAD_SIGMA = 1.4826  # MAD to Normal sigma
Z25, Z10 = 0.6745, 1.2816  # inverse Normal at .75 and .90
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def d(value: float) -> Column:
    return F.lit(float(value))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clamp, keeping null as null (greatest/least alone would replace it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, d(hi)), d(lo)))


def clip_between(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def ratio(a: Column, b: Column) -> Column:
    """Division where a zero denominator gives null."""
    return a / F.nullif(b, d(0))


def safe_log(x: Column) -> Column:
    """Log of a price; zero and below give null."""
    return F.when(x > 0, F.log(x))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(values: dict[str, Column]) -> dict[str, Column]:
    """Stable softmax over a fixed set of columns."""
    top = F.greatest(*values.values())
    weights = {k: F.exp(v - top) for k, v in values.items()}
    total = sum(weights.values(), d(0))
    return {k: w / total for k, w in weights.items()}


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def pinball(y: Column, q: Column, tau: float) -> Column:
    err = y - q
    return F.greatest(err * tau, err * (tau - 1.0))


def mixed(x: Column) -> Column:
    """The low 32 bits of a whole number hashed by shifts and a multiplication, which any SQL engine can repeat."""
    x = x.bitwiseAND(F.lit(0xFFFFFFFF))
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(0x45D9F3B)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(x, 16).bitwiseXOR(x)
