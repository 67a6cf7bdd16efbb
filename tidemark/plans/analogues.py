"""Analogue days: fit, index and query in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import similarity as S
from tidemark.plans.panel import latest_panel_row


def analogues_of(panel: DataFrame, features: list[str], label: str, asof: str, k: int = 10, gap_days: int = 30,
                 vix_band: float | None = 0.35, scaler: DataFrame | None = None) -> DataFrame:
    """The k past days most similar to the newest panel row at `asof`, in a comparable volatility regime."""
    import datetime as dt

    scaler = scaler if scaler is not None else S.fit_index_scaler(panel, features, label)
    index = S.build_index(panel, features, label, scaler)
    row = latest_panel_row(panel, asof)
    query = S.scaled_vector(row, features, scaler, ["vix_close"])
    same_regime = None
    if vix_band is not None:
        v = F.col("_q_vix_close")
        # An unknown or non-positive level puts no bound.
        same_regime = F.coalesce(v <= 0, F.lit(True)) | F.col("vix_close").between(v * (1 - vix_band), v * (1 + vix_band))
    newest = (dt.date.fromisoformat(asof) - dt.timedelta(days=gap_days)).isoformat()
    return S.retrieve(index, query, k, newest, condition=same_regime)
