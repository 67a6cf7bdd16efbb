"""Compare each statement with the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import added_words
from tidemark.operators.blocks import Order, block_window, index_rows, own_rows, with_blocks


def with_previous(df: DataFrame, text: str, order: Order, size: int = 1024) -> DataFrame:
    """Add `previous`, the text before this one in order ('' at the start)."""
    blocked = with_blocks(index_rows(df, order), size, 1)
    prev = F.coalesce(F.lag(text).over(block_window(order.keys)), F.lit(""))
    return own_rows(blocked.withColumn("previous", prev)).drop("rn")


def word_changes(df: DataFrame, text: str, order: Order) -> DataFrame:
    """Distinct words gained and lost against the previous statement."""
    out = with_previous(df, text, order)
    return out.withColumns({
        "added": F.filter(added_words(F.col("previous"), F.col(text)), lambda w: w != ""),
        "removed": F.filter(added_words(F.col(text), F.col("previous")), lambda w: w != ""),
    })

