"""Classifiers: what they learn holds on rows they haven't seen; the pipeline against plain Python."""

import binascii

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF_DIR
from tests.llm.test_duplicates import brute_alike_groups, brute_lines
from tidemark.llm import quality, secrets, toxicity
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES, VOCAB
from tidemark.llm.trees import Trees, fit_trees


def test_trees_find_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = fit_trees(x[:1000], y[:1000])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert fit_trees(x[:0], y[:0]).probability(x[:2]).min() > 0.99


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(2)
    model = Trees(rng.integers(0, 3, (4, 7)), rng.normal(size=(4, 7)), rng.normal(size=(4, 8)), 0.5)
    x = rng.normal(size=(50, 3))

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            n = 0
            while n < 7:
                n = 2 * n + (2 if row[f[n]] > t[n] else 1)
            total += v[n - 7]
        return total

    assert np.allclose(model.raw(x), [walk(r) for r in x])


def test_quality_on_held_out_rows(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op10_quality"](spark, sf_dir).collect()}
    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert all(r.held_out == (binascii.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    labels = [(r.quality, rows[r.doc_id]) for r in table(spark, sf_dir, "labels").collect() if rows[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in labels]) > 0.85
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())


def test_quality_of_odd_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = frame([(1, "some plain text"), (2, "!! !! !!"), (None, None), (4, ""), (4, ""), (5, "w " * 9000)])
    assert quality.classify(docs, labels).count() == 6
    assert quality.classify(frame([]), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).select(F.min("predicted")).first()[0] == 1
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(3)
    n, f = 1500, 6
    x = rng.integers(0, 3, (n, f)).astype(float)
    latent = x @ np.array([2.0, 1.0, 0, 0, -1.0, 0]) + rng.logistic(size=n) * 0.3
    grade = np.searchsorted([2.0, 4.0, 5.5], latent)
    row, column = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(row, column, x[row, column], grade, f, steps=600)
    model = toxicity.Ordinal({}, weights, cuts)
    p = model.grades(x @ weights)
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(cuts) >= 0).all()
    assert (p.argmax(axis=1) == grade).mean() > 0.8
    assert np.corrcoef(p @ np.arange(4), grade)[0, 1] > 0.9


def test_toxicity(spark, frame):
    rng = np.random.default_rng(4)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    docs, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, 30))
        toxic = i % 5 == 0
        if toxic:
            words[3:3 + 1 + i % 7] = [["vile", "grimly" + plain[i % 50]][i % 2]] * (1 + i % 7)
        docs.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs += [(900, None), (901, ""), (None, "vile vile vile")]
    frame_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(frame(docs), frame_labels)
    rows = {r.doc_id: r for r in toxicity.severity(frame(docs), model).collect()}
    assert np.mean([rows[i].toxic == (i % 5 == 0) for i in range(300, 400)]) > 0.95
    assert not rows[900].toxic and not rows[901].toxic and rows[None].toxic
    assert all(0 <= r.severity <= 3 for r in rows.values())
    empty = toxicity.fit_toxicity(frame(docs), frame_labels.limit(0))
    assert not any(r.toxic for r in toxicity.severity(frame(docs), empty).collect())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.columns == columns, name
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        kept = after
    texts = {r.doc_id: r.text for r in kept.collect()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)


def redacted(text, spans):
    """Text with each union of overlapping spans blotted out, by marking characters."""
    unions = []
    for a, _, b in spans:
        if unions and a < unions[-1][1]:
            unions[-1][1] = max(b, unions[-1][1])
        else:
            unions.append([a, b])
    for a, b in reversed(unions):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.probability(np.array([quality.statistics(t)]))[0] >= 0.5]
    rows = [(i, t) for (i, _), t in zip(rows, brute_lines(rows))]
    ids = [i for i, _ in rows]
    rows = [r for r, g in zip(rows, brute_alike_groups(ids, [t for _, t in rows])) if g == r[0]]
    library = Tokenizer.from_file(VOCAB)
    library.no_truncation()
    library.no_padding()
    want = {i: library.encode(redacted(t, secrets.find(t)[1]), add_special_tokens=False).ids + [1] for i, t in rows}
    got: dict = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.length == len(r.ids) == 1 << r.bucket <= 2048
        got[r.doc_id] += r.ids
    assert got == want and len(got) < docs.count()


def test_stages_pass_clashing_columns_through(spark, sf_dir, frame):
    import corpus_pipeline

    names = ["quality_score", "dropped_lines", "component_id", "fp", "id", "text_hash", "line", "h1", "slice", "ids", "start",
             "_drops", "label", "y", "score"]
    docs = frame([(1, "a plain text of some words"), (2, None), (None, "x"), (3, ""), (3, "")]).withColumns(
        {n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            after = stage(spark, rows, sf_dir)
            assert after.columns == docs.columns, name
            assert all(r[n] == f"own {n}" for r in after.collect() for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
