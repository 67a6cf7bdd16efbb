"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprint, lines, merkle, neardup, packing, pieces, quality, rtree, secrets, topk, toxicity, warc
from tidemark.llm.common import table
from tidemark.session import shared_dir

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), VOCAB)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), VOCAB)


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[secrets.number_of("base", k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


@query
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


@query
def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@query
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), PIECES)


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLES["op12_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.key, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS alike,
         CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON o.vec_id <> a.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT key, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS place
  FROM s WHERE alike
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.key, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.key = p.key AND NOT s.alike
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def leaf(text: Column) -> Column:
        return merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                      F.translate(text, capitals, capitals.lower())).otherwise(text)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("tree"), F.unhex(leaf(text)).alias("digest"),
        F.when(~tampered.eqNullSafe(text), F.unhex(leaf(tampered))).alias("tampered"))
    tree = merkle.manifest(docs, ["doc_id", "tampered"])
    found = merkle.folded(F.lower(F.hex(F.coalesce("tampered", "digest"))), F.col("witness"))
    return tree.select("doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", "root",
                       F.sha2(merkle.siblings(F.col("witness")), 256).alias("proof_sha256"), found.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the comparison spells out: enough for 8 ** 6 rows of a language and 8 ** 2 languages.
TREE_LEVELS, FOREST_LEVELS = 6, 2


def tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs: nodes of each level (tree, i, d, n), and `name`_up(level, tree, i, kids): the nodes below each node."""
    out = [f"{name}_0 AS ({leaves})"]
    for level in range(1, levels + 1):
        out.append(f"{name}_{level} AS (SELECT tree, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, "
                   "CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d, "
                   "CAST(ceil(max(n) / 8.0) AS BIGINT) AS n "
                   f"FROM {name}_{level - 1} GROUP BY tree, CASE WHEN n > 1 THEN i // 8 ELSE i END)")
    return ", ".join(out)


def climb_sql(start: str, name: str, levels: int, key: str) -> str:
    """CTEs that climb from `start` (row, key, i, cur, proof): the siblings of each level are folded in."""
    out, last = [], start
    for level in range(levels):
        step = f"{start}_{level}"
        out.append(f"""{step} AS (
  SELECT r.row, r.{key}, any_value(r.i) // 8 AS i,
         CASE WHEN max(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.i = r.i THEN r.cur ELSE s.d END, '' ORDER BY s.i))
              ELSE any_value(r.cur) END AS cur,
         any_value(r.proof) || coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i <> r.i), '') AS proof
  FROM {last} r JOIN {name}_{level} s ON s.tree = r.{key} AND s.i // 8 = r.i // 8
  GROUP BY r.row, r.{key})""")
        last = step
    return ", ".join(out)


def field_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


LEAF_SQL = "sha256(" + " || ".join(map(field_sql, ["doc_id", "source", "lang", "n_chars", "{text}"])) + ")"
ORACLES["op13_merkle"] = f"""
WITH docs AS (
  SELECT *, coalesce('1' || lang, '0') AS tree, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                                            lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS crc
  FROM documents
), told AS (
  SELECT doc_id, tree, {LEAF_SQL.format(text="text")} AS leaf,
         CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
              ELSE text END AS other, source, lang, n_chars
  FROM docs
), leaves AS (
  SELECT doc_id, tree, leaf, {LEAF_SQL.format(text="other")} AS tampered,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row
  FROM told
), {tree_sql("t", "SELECT tree, i, leaf AS d, n FROM leaves", TREE_LEVELS)}
, subroots AS (
  SELECT tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t_{TREE_LEVELS}
), {tree_sql("f", "SELECT 0 AS tree, i, d, n FROM subroots", FOREST_LEVELS)}
, a AS (SELECT row, tree, i, tampered AS cur, '' AS proof FROM leaves)
, {climb_sql("a", "t", TREE_LEVELS, "tree")}
, b AS (SELECT r.row, 0 AS key, s.i, r.cur, r.proof FROM a_{TREE_LEVELS - 1} r JOIN subroots s ON s.name = r.tree)
, {climb_sql("b", "f", FOREST_LEVELS, "key")}
SELECT l.doc_id, l.leaf, s.d AS subroot, f.d AS root, sha256(b.proof) AS proof_sha256, b.cur AS folded_root,
       b.cur = f.d AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN b_{FOREST_LEVELS - 1} b ON b.row = l.row, f_{FOREST_LEVELS} f
"""
