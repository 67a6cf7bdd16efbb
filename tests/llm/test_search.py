"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in whole if i % 5 == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for own, a in whole if own == q
                       for i, b in whole if i != q and len(b) == len(a))
        out += [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, 40)) * rng.exponential(1, size=40)
    rows = [(i, [float(x) for x in base[rng.integers(30)] + rng.normal(size=40) * rng.choice([0, .1])]) for i in range(400)]
    rows += [(3, rows[3][1]), (7, [1.0] * 40), (7, [2.0] * 40), (10, [0.5] * 40), (500, None), (505, [None] * 40), (510, [float("nan")] + [0.0] * 39),
             (515, [float("inf")] * 40), (520, []), (521, []), (525, [1.0, 2.0]), (526, [3.0, 4.0]), (None, [0.0] * 40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, query_cells=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_huge_components_and_few_rows(spark):
    rows = [(5, [1e30, 2.0]), (6, [1e30, -1.0]), (7, [-1e30, 0.0]), (10, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0).collect())) == brute(rows, 5)


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
