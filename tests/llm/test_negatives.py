"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rtree

SCHEMA = "vec_id long, embedding array<float>, label int, key string"


def brute(rows):
    whole = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows
             if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in whole:
        if i % 50:
            continue
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j, m)
                        for j, m, w in whole if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == l][:5]:
            far = [x for x in scored if x[2] != l and 50 * s >= 100 * x[0] >= 95 * s][:3]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], SCHEMA)
    return sorted(map(tuple, rtree.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"), **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 20))
    rows = [(i, [float(x) for x in centres[rng.integers(12)] + rng.normal(size=20) * rng.choice([0, .3])], int(rng.integers(4)))
            for i in range(1500)]
    rows += [(7, rows[7][1], 2), (50, rows[51][1], 1), (50, rows[50][1], rows[50][2]), (1600, None, 1), (1650, [1.0] * 20, None),
             (1700, [None] * 20, 1), (1701, [float("nan")] + [0.0] * 19, 1), (1750, [float("inf")] * 20, 1),
             (None, [0.0] * 20, 1), (1800, [], 1), (1801, [], 2), (1802, [], 1), (1850, [1.0, 2.0], 3), (1851, [3.0, 4.0], 3),
             (1852, [2.0, 2.5], 0)]
    assert mined(spark, rows, query_cells=2) == brute(rows) != []


def test_one_vector_for_a_third_of_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [0.5, 0.25, 0.125] if i % 3 else [float(x) for x in rng.normal(size=3)], i % 2) for i in range(900)]
    assert mined(spark, rows) == brute(rows)


def test_huge_components(spark):
    rows = [(50, [1e30, 2.0], 1), (6, [1e30, -1.0], 1), (7, [1e29, 0.0], 0), (8, [-1e30, 0.0], 0), (100, [3e7, 2e7], 1),
            (101, [3e7, 1e7], 1), (102, [1.5e7, 1e7], 0)]
    assert mined(spark, rows) == brute(rows)


def test_tiles_group_rows_into_slabs():
    rng = np.random.default_rng(4)
    points = rng.uniform(size=(5000, 3)) * [1, 5, 3]
    order = rtree.tiled_order(points)
    assert sorted(order) == list(range(5000))
    leaves = [points[order[i:i + rtree.LEAF]] for i in range(0, 5000, rtree.LEAF)]
    volume = np.mean([np.prod(x.max(axis=0) - x.min(axis=0)) for x in leaves])
    assert volume < 0.1 * 15


def test_boxes_spare_most_rows():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(8000, 3)) * 256)
    order = rtree.tiled_order(points)
    forest = rtree.Forest([{"dims": 3, "ids": order.astype(np.int64).tobytes(), "labels": np.ones(8000, np.int64).tobytes(),
                            "kind": "<i4", "vectors": points[order].astype("<i4").tobytes()}])
    read = []
    scores = forest.scores
    forest.scores = lambda a, b, q: read.append(b - a) or scores(a, b, q)
    query = points[17]
    low, high = forest.bounds(query[None])
    found = forest.search(query, 17, 1, True, [(-math.inf, math.inf)], 5, low[0], high[0])[0]
    every = sorted((-int(points[i] @ query), i) for i in range(8000) if i != 17)
    assert found == every[:5]
    assert sum(read) < 2000


def test_empty_table(spark):
    assert mined(spark, []) == []
