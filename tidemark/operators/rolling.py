"""Long rolling statistics in Arrow batches, one block of a key at a time.

Spark's sliding frames rebuild their buffer for every row, which costs a full window per row; sorted
windows in numpy and pandas slide. Blocks are bounded, so a task holds one block with its lead-in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.blocks import BLOCK, HALO, spread, with_blocks


def map_blocks(numbered: DataFrame, keys: tuple[str, ...], value: str,
               fn: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outputs: tuple[str, ...], size: int,
               halo: int) -> DataFrame:
    """Apply fn(values, rn) to each block including its lead-in and keep the block's own rows."""
    columns = numbered.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema],
                        *[f"{o} double" for o in outputs]])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable").reset_index(drop=True)
        out = fn(pdf[value].to_numpy(dtype=np.float64), pdf["rn"].to_numpy())
        return pdf.assign(**out).loc[~pdf[HALO], [*columns, *outputs]]

    blocks = spread(with_blocks(numbered, size, halo), *keys, BLOCK)
    return blocks.groupBy(*keys, BLOCK).applyInPandas(block, schema)


def rolling_median_mad(x: np.ndarray, window: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Median of the last `window` values and the median distance of those values from it."""
    med, mad = np.empty(len(x)), np.empty(len(x))
    for i in range(min(len(x), window - 1)):
        seen = x[:i + 1]
        med[i] = np.median(seen)
        mad[i] = np.median(np.abs(seen - med[i]))
    if len(x) >= window:
        views = np.lib.stride_tricks.sliding_window_view(x, window)
        for at in range(0, len(views), chunk):
            part = views[at:at + chunk]
            m = np.median(part, axis=1)
            to = slice(window - 1 + at, window - 1 + at + len(part))
            med[to] = m
            mad[to] = np.median(np.abs(part - m[:, None]), axis=1)
    return med, mad


def rolling_quantiles(x: np.ndarray, window: int, levels: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Number of known values and their quantiles over the last `window` rows, missing values skipped."""
    roll = pd.Series(x).rolling(window, min_periods=1)
    return roll.count().to_numpy(), np.column_stack([roll.quantile(q).to_numpy() for q in levels])
