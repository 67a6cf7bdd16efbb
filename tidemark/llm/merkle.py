"""Merkle manifest of a dataset: trees by key and one above them, with a witness for each leaf.

Leaves are appended in order to a row of open runs, one run per level. A run that is full becomes one node of the level
above, and that is when each of its nodes gets its siblings: they extend the witnesses of all leaves below it. Blocks of
leaves are aligned with the tree, so a block's root is a node of it and is appended to the next tree in its turn.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import numbered
from tidemark.session import write_through

ARITY = 8
#: Levels of a block, which one task appends: 4,096 leaves.
LEVELS = 4
WITNESS = "array<struct<left:string,right:string>>"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """An append-only tree: the open run of each level, and the partial witnesses of the leaves below its nodes."""

    def __init__(self):
        self.open: list[list[tuple[str, list]]] = [[]]

    def append(self, digest: str, witness: list) -> None:
        """A leaf; `witness` is extended with (digests to the left, digests to the right) as its siblings complete."""
        self.open[0].append((digest, [witness]))
        level = 0
        while len(self.open[level]) == ARITY:
            self.complete(level)
            level += 1

    def complete(self, level: int) -> None:
        """The open run of a level becomes a node of the next."""
        run, self.open[level] = self.open[level], []
        below = []
        for i, (_, witnesses) in enumerate(run):
            step = {"left": "".join(d for d, _ in run[:i]), "right": "".join(d for d, _ in run[i + 1:])}
            for w in witnesses:
                w.append(step)
            below += witnesses
        if level + 1 == len(self.open):
            self.open.append([])
        self.open[level + 1].append((digest_of("".join(d for d, _ in run)), below))

    def root(self, height: int) -> str:
        """Completes what is open, level by level, up to the one node of that height."""
        for level in range(height):
            if self.open[level]:
                self.complete(level)
        return self.open[height][0][0]


def height_of(total: int) -> int:
    """Levels above the leaves of a block: of the tree if it fits into a block, of a whole block otherwise."""
    height = 0
    while ARITY ** height < total and height < LEVELS:
        height += 1
    return height


def grown(nodes: pa.Table) -> tuple[pa.Table, str, list]:
    """A block's nodes in order, its root, and the witness of each node up to that root."""
    nodes = nodes.sort_by("place")
    tree, witnesses = Appender(), [[] for _ in range(nodes.num_rows)]
    for digest, witness in zip(nodes.column("digest").to_pylist(), witnesses):
        tree.append(digest.hex(), witness)
    return nodes, tree.root(height_of(nodes.column("total")[0].as_py())), witnesses


def blocks_of(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / ARITY ** LEVELS).cast("long"))


def roots_of(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks of each tree: the nodes (tree, place, total, digest) of the next round."""

    def run(nodes: pa.Table) -> pa.Table:
        first, root, _ = grown(nodes)
        blocks = -(-first.column("total")[0].as_py() // ARITY ** LEVELS)
        return pa.table({"tree": first.column("tree")[:1], "place": first.column("block")[:1],
                         "total": pa.array([blocks], pa.int64()), "digest": pa.array([bytes.fromhex(root)], pa.binary())})

    return blocks_of(nodes).select("tree", "block", "place", "total", "digest").groupBy("tree", "block") \
        .applyInArrow(run, "tree string, place long, total long, digest binary")


def appended(nodes: DataFrame, stem: str) -> list[DataFrame]:
    """The rounds from the leaves to one node per tree; their number comes from the largest tree."""
    rounds = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 1
    while most > 1:
        rounds.append(write_through(roots_of(rounds[-1]), stem))
        most = -(-most // ARITY ** LEVELS)
    return rounds


def extended(nodes: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """`nodes` with their witness up to the very root: their own within the block, then that of the block's root.

    `above` holds one row per block: tree, place (the block), subroot, root, witness. `keep` names columns of `nodes`.
    """
    fields = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in ["tree", "place", "digest", *keep]) \
        + f", subroot string, root string, witness {WITNESS}"
    out = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, _, witnesses = grown(nodes)
        rest = above.column("witness")[0].as_py()
        both = {c: nodes.column(c) for c in ["tree", "place", "digest", *keep]}
        for c in ("subroot", "root"):
            both[c] = pa.array([above.column(c)[0].as_py()] * nodes.num_rows, pa.string())
        return pa.table(both | {"witness": pa.array([w + rest for w in witnesses], out)})

    left = blocks_of(nodes).select("tree", "block", "place", "total", "digest", *keep)
    right = above.select("tree", F.col("place").alias("block"), "subroot", "root", "witness")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(run, schema)


def descended(rounds: list[DataFrame], top: DataFrame, keep: list[str]) -> DataFrame:
    """The leaves of `rounds` with their witnesses; `top` has one row per tree."""
    for nodes in rounds[-2::-1] if len(rounds) > 1 else []:
        top = extended(nodes, top, keep if nodes is rounds[0] else [])
    return top


def manifest(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """The Merkle tree over `leaves` (tree, digest, and what `keep` names): subroot, root and witness of each.

    `tree` is a string that names the leaf's tree and may be null; `digest` is the leaf's SHA-256 as 32 bytes. Leaves of
    a tree are in the order of the columns of `keep`, then of their digests. Every ARITY consecutive nodes become the
    SHA-256 of their joined hex digests (the last run may be shorter, even one) until one is left, the subroot; subroots
    in the order of their tree's name (null first, bytewise) make the root in the same way. The result has `tree`,
    `place` (0-based), `digest`, `keep`, `subroot`, `root` as hex and `witness`, the siblings (left, right) of each level
    as joined hex digests; a leaf without any, and no leaf at all, are no special cases.

    Equal rows are leaves of their own. A tree of any size is numbered and hashed in blocks of ARITY ** LEVELS leaves;
    a round hands on one row per block. Nothing but the size of the largest tree reaches the driver.
    """
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("1"), F.col("tree")), F.lit("0")))
    rows = write_through(numbered(named.select("tree", "digest", *keep), ["tree"], [*keep, "digest"]), "leaves")
    rounds = appended(rows, "nodes")
    tops = rounds[-1].select("tree", "digest")
    trees = write_through(numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["tree"],
                                   ["name"]), "subroots")
    forest = appended(trees, "roots")
    root = forest[-1].select("tree", "place", "digest", F.lit("").alias("subroot"),
                             F.lower(F.hex("digest")).alias("root"),
                             F.array().cast(WITNESS).alias("witness"), *(["name"] if len(forest) == 1 else []))
    tops = descended(forest, root, ["name"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), F.lower(F.hex("digest")).alias("subroot"), "root",
        "witness", "digest")
    if len(rounds) == 1:
        tops = rows.select("tree", "place", *keep).join(tops.drop("place"), "tree")
    done = descended(rounds, tops, keep)
    name = F.when(F.col("tree") != "0", F.substring(F.col("tree"), 2, 1 << 30)).alias("tree")
    return done.select(name, "place", "digest", *keep, "subroot", "root", "witness")


def leaf_of(*fields: Column) -> Column:
    """SHA-256 (hex) of fields: `-` for null, else the UTF-8 bytes' number, a colon, the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]).cast("binary"), 256)


def folded(digest: Column, witness: Column) -> Column:
    """The root that a leaf (hex) and its witness lead to."""
    return F.aggregate(witness, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(witness: Column) -> Column:
    """All digests of a witness, level by level and from left to right, joined."""
    return F.array_join(F.transform(witness, lambda step: F.concat(step["left"], step["right"])), "")
