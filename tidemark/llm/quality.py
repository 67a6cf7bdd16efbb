"""Quality classifier: boosted trees over statistics of a document's whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, slices, texts_of
from tidemark.llm.trees import Trees, fit_trees

#: Labelled rows that a classifier is fitted on, at most; taken by a hash of the id.
SAMPLE = 20_000
#: Characters of a slice of documents whose texts a worker holds at once.
CHARS = 1 << 19
FEATURES = ("log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeated_word", "upper", "digit",
            "space", "newline", "letter", "exclamation", "pipe", "symbol", "other_punctuation", "distinct_lines",
            "longest_word", "letter_words")
SCORE_SCHEMA = "doc_id long, score double"


def statistics(text: str) -> list[float]:
    """FEATURES of one text; shares are 0 for an empty one."""
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    w = max(1, len(words))
    tally = Counter(words)
    lines = text.split("\n")
    upper, lower, digit = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    wide = int(count[128:].sum())
    symbol = int(count[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 96, 126]].sum())
    other = int(count[33:127].sum()) - upper - lower - digit - symbol - int(count[33]) - int(count[124])
    return [np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / w, len(tally) / w,
            max(tally.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, upper / max(1, upper + lower),
            digit / n, count[32] / n, count[10] / n, (upper + lower + wide) / n, count[33] / n, count[124] / n, symbol / n,
            other / n, len(set(lines)) / len(lines), min(100, max(map(len, words), default=0)),
            sum(map(str.isalpha, words)) / w]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """doc_id, text, y of at most `limit` labelled rows that aren't held out, the same ones on every run.

    Null labels are left out; a doc_id with several labels has the largest.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")


def measured(rows: DataFrame) -> DataFrame:
    """y and the statistics x of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"),
                                              pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Trees:
    """Trees from a bounded sample of labelled rows; only its statistics, a few numbers a row, come to the driver."""
    rows = measured(sample_rows(docs, labels, "quality", limit)).toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    return fit_trees(x, rows.column("y").to_numpy())


def score_quality(docs: DataFrame, model: Trees, column: str = "quality_score") -> DataFrame:
    """`docs` with `column` (0 to 1, higher: better) in place of any of that name; null texts count as empty."""
    docs = docs.drop(column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, CHARS) for b in batches):
            x = np.array([statistics(t) for t in texts_of(batch)], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(x))], [*names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{column}` double")


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`.

    Scores depend on the text alone. Repeated rows and null ids are scored like others; without usable labels every
    score is 1 less a thousandth. Documents that share an id with a label are all learned from.
    """
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                           fit_quality(docs, labels, limit)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with all their columns, whatever their names."""
    column = free_name("quality_score", docs)
    return score_quality(docs, fit_quality(docs, labels, limit), column).where(F.col(column) >= 0.5).drop(column)
