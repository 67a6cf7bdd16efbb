"""The Merkle manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(leaves):
    """Root of a list, and for each leaf its siblings (left, right) level by level."""
    nodes, members, steps = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for n in run:
                for leaf in members[n]:
                    steps[leaf].append(("".join(nodes[m] for m in run if m < n), "".join(nodes[m] for m in run if m > n)))
        nodes, members = [h("".join(nodes[m] for m in r)) for r in runs], [sum((members[m] for m in r), []) for r in runs]
    return nodes[0], steps


def expected(rows):
    trees = {}
    for tree, key, text in rows:
        trees.setdefault(tree, []).append((key is not None, key or 0, bytes.fromhex(h(text))))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subs = [plain([d.hex() for *_, d in sorted(trees[t])]) for t in names]
    root, above = plain([s for s, _ in subs])
    out = []
    for t, (sub, steps), up in zip(names, subs, above):
        for place, ((known, key, d), own) in enumerate(zip(sorted(trees[t]), steps)):
            out.append((t, place, key if known else None, d.hex(), sub, root, tuple(own + up)))
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame([(t, k, h(x)) for t, k, x in rows], "tree string, key long, hash string")
    tree = merkle.manifest(df.select("tree", "key", F.unhex("hash").alias("digest")), ["key"])
    fold = merkle.folded(F.lower(F.hex("digest")), F.col("witness")) == F.col("root")
    rows = tree.withColumn("ok", fold).collect()
    assert all(r.ok for r in rows)
    return sorted(((r.tree, r.place, r.key, r.digest.hex(), r.subroot, r.root, tuple(map(tuple, r.witness))) for r in rows), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 9, None: 8, "": 1}, {"a": 4097, "b": 1, "é": 65}, {str(i): i % 4 + 1 for i in range(70)}])
def test_same_as_a_plain_tree(spark, sizes):
    rows = [(t, i * 7919 % 100_003, f"{t}{i}") for t, n in sizes.items() for i in range(n)]
    assert built(spark, rows) == expected(rows)


def test_repeated_rows_and_missing_keys(spark):
    rows = [("a", None, "x"), ("a", None, "x"), ("a", None, "y"), ("a", 1, "x"), ("a", 1, "w"), ("a", 1, "w"), (None, None, "")]
    assert built(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert built(spark, []) == []


def test_a_changed_leaf_leads_to_another_root(spark):
    df = spark.createDataFrame([("a", i, h(str(i))) for i in range(100)], "tree string, key long, hash string")
    tree = merkle.manifest(df.select("tree", "key", F.unhex("hash").alias("digest")), ["key"])
    wrong = F.when(F.col("key") % 10 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.lower(F.hex("digest")))
    rows = tree.select("key", (merkle.folded(wrong, F.col("witness")) == F.col("root")).alias("ok")).collect()
    assert {r.key for r in rows if not r.ok} == set(range(0, 100, 10))


def test_fields_of_a_leaf(spark):
    row = spark.sql("SELECT 5L AS i, 'é' AS t, '' AS e, CAST(NULL AS STRING) AS n")
    got = row.select(merkle.leaf_of(F.col("i"), F.col("t"), F.col("e"), F.col("n"))).first()[0]
    assert got == h("1:52:é0:-")


def test_a_growing_tree_completes_witnesses():
    tree, witnesses = merkle.Appender(), [[] for _ in range(20)]
    for i in range(20):
        tree.append(h(str(i)), witnesses[i])
        assert [len(w) for w in witnesses[:i + 1]] == [int(k < (i + 1) // 8 * 8) for k in range(i + 1)]
    root, steps = plain([h(str(i)) for i in range(20)])
    assert tree.root(2) == root
    assert [[(s["left"], s["right"]) for s in w] for w in witnesses] == steps
