"""Reading tables and small helpers that the operators here share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, df: DataFrame) -> str:
    """`name`, lengthened until no column of `df` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def by_size(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `chars` characters; one longer text is a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch: pa.RecordBatch, chars: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `chars` characters; one longer text is a slice of its own.

    Only the texts of one slice need stand as Python strings at a time.
    """
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > chars:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield batch.slice(begin)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
