"""Toxicity as ordered grades: cumulative-link regression on sparse word features, one weight vector for all thresholds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts_of
from tidemark.llm.quality import SAMPLE, sample_rows

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features besides the word itself, for inflected forms.
PREFIXES = (4, 5, 6)
#: Features kept, by how much more often they stand in texts of one kind than of the other.
MOST_FEATURES = 2000
LEAST_TEXTS = 8
#: Standard errors that a feature's shares among toxic and other texts must lie apart, against features of chance.
LEAST_DISTANCE = 4.0
#: A toxic text has the grade 1 up to so many marked features (a word has up to four), then 2, then 3.
GRADE_EDGES = (2, 4)
GRADES = 4
#: Words that a worker remembers the features of, at most.
MEMO = 1 << 18


def features_of(word: str) -> list[str]:
    return [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) > k]


@dataclass(frozen=True)
class Ordinal:
    """P(grade > j) = sigmoid(w . x - cuts[j]), with x = log2(1 + count) of each feature."""

    names: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def scores(self, texts: list[str], memo: dict[str, tuple[int, ...]]) -> np.ndarray:
        return np.array([sum(self.weights[f] * np.log2(1 + c) for f, c in counted(t, self.names, memo).items())
                         for t in texts], float)

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probabilities of the grades, one row per text."""
        above = 1 / (1 + np.exp(-np.clip(scores[:, None] - self.cuts, -30, 30)))
        edges = np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))])
        return edges[:, :-1] - edges[:, 1:]


def counted(text: str, names: dict[str, int], memo: dict[str, tuple[int, ...]]) -> Counter:
    """How often each known feature stands in the text."""
    if len(memo) > MEMO:
        memo.clear()
    out: Counter = Counter()
    for word in WORD.findall(text.lower()):
        known = memo.get(word)
        if known is None:
            known = memo[word] = tuple(names[f] for f in features_of(word) if f in names)
        if known:
            out.update(known)
    return out


def feature_table(sample: DataFrame) -> list[tuple[str, float]]:
    """Up to MOST_FEATURES features and their signed distance between toxic and other texts, from counts over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(texts_of(batch), batch.column("y").to_pylist()):
                found = sorted({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.float64())],
                                                 ["feature", "y"])

    rows = sample.select("text", "y").dropDuplicates(["text"])
    toxic, other = (rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first() or (0, 0))
    toxic, other = (toxic or 0.0) + 1, (other or 0.0) + 1
    counts = rows.mapInArrow(run, "feature string, y double").groupBy("feature").agg(
        F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    p, q = F.col("a") / toxic, F.col("b") / other
    both = (F.col("a") + F.col("b")) / (toxic + other)
    z = (p - q) / F.sqrt(both * (1 - both + 1e-9) * (1 / toxic + 1 / other))
    kept = counts.select("feature", z.alias("z")).where(F.abs("z") >= LEAST_DISTANCE).orderBy(F.desc(F.abs("z")), "feature").limit(MOST_FEATURES).collect()
    return [(r.feature, r.z) for r in kept]


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, steps: int = 300) -> Ordinal:
    """Fit on a bounded sample of labelled rows; only its counts of the kept features come to the driver.

    Labels say toxic or not; the grade of a toxic text grows with its marked features, those that stand far
    more often in toxic texts than in others (a distance over half the largest), and is 0 for all other texts.
    """
    sample = sample_rows(docs, labels, "toxic", limit)
    table = feature_table(sample)
    names = {f: i for i, (f, _) in enumerate(table)}
    distance = np.array([z for _, z in table])
    marks = distance > 0.5 * max(distance.max(initial=0.0), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            found = [counted(t, names, memo) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([list(c) for c in found], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "y", "f", "c"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(
        run, "doc_id long, y double, f array<int>, c array<int>").toArrow().sort_by("doc_id")
    f, c = rows.column("f").to_pylist(), rows.column("c").to_pylist()
    of = np.repeat(np.arange(len(f)), [len(x) for x in f])
    column = np.array([j for x in f for j in x], np.int64)
    count = np.array([j for x in c for j in x], float)
    words = np.bincount(of, count * marks[column] if len(column) else count, len(f))
    grade = np.where(rows.column("y").to_numpy() > 0, 1 + np.searchsorted(GRADE_EDGES, words), 0)
    weights, cuts = fit_ordinal(of, column, np.log2(1 + count), grade, len(names), steps)
    return Ordinal(names, weights, cuts)


def fit_ordinal(row, column, value, grade, features: int, steps: int = 300, rate: float = 0.1,
                ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts that make the given grades likeliest; Adam on the mean gradient, sparse x."""
    n, classes = len(grade), GRADES - 1
    weights, cuts = np.zeros(features), np.arange(1.0, classes + 1)
    if n == 0 or grade.max(initial=0) == 0:
        return weights, np.arange(5.0, 5.0 + classes)  # nothing toxic was seen
    moments = np.zeros(features + classes), np.zeros(features + classes)
    for t in range(1, steps + 1):
        s = np.bincount(row, weights[column] * value, n)
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = edges * (1 - edges)
        at = np.arange(n)
        p = np.maximum(edges[at, grade] - edges[at, grade + 1], 1e-12)
        by_score = (slope[at, grade] - slope[at, grade + 1]) / p
        by_cut = np.zeros((n, classes + 2))
        by_cut[at, grade] = -slope[at, grade] / p
        by_cut[at, grade + 1] += slope[at, grade + 1] / p
        gradient = np.concatenate([np.bincount(column, by_score[row] * value, features) / n - ridge * weights,
                                   by_cut[:, 1:-1].mean(axis=0)])
        first = moments[0] * 0.9 + 0.1 * gradient
        second = moments[1] * 0.999 + 0.001 * gradient ** 2
        moments = first, second
        step = rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        weights, cuts = weights + step[:features], np.maximum.accumulate(cuts + step[features:])
    return weights, cuts


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic, grade (the likeliest), toxic (p_toxic of half or more).

    Null and empty texts have no features and so the severity of a text without marks. Repeated rows and null ids are
    kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            p = model.grades(model.scores(texts_of(batch), memo))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p @ np.arange(GRADES)), pa.array(1 - p[:, 0]),
                 pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] <= 0.5)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
