"""Text queries over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, stripped
from tidemark.functions import text as X
from tidemark.operators import statements
from tidemark.operators.blocks import Order

# Words that are frequent in the supplied prose, so that the counts are not all zero.
LOCAL = {"fear": ["ent", "sch"], "greed": ["the", "tion"], "uncertainty": ["eaux", "ing"], "calm": ["de", "cion"]}
LOCAL_POS, LOCAL_NEG = ["the", "le", "und", "el"], ["that", "et", "der", "que"]

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+'), lambda w: w <> '')"


def _emotion_sql(vocab) -> str:
    shares = ", ".join(
        f"len(list_filter(w, lambda x: regexp_matches(x, '{'|'.join(terms)}'))) / (len(w) + 1e-8) "
        f"* {X.EMOTION_WEIGHTS[name]}e0 AS {name}" for name, terms in vocab.items())
    names = list(vocab)
    scaled = ", ".join(f"{n} / ({' + '.join(names)} + 1e-8) AS {n}_share" for n in names)
    return f"""
WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, {shares} FROM t),
r AS (SELECT doc_id, {scaled} FROM s)
SELECT doc_id, {rounded_sql({f"{n}_share": 6 for n in names})} FROM r"""


def _emotions(spark, sf_dir, vocab):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = X.with_emotions(docs, "text", vocab).drop("text")
    return rounded(out, {f"{n}_share": 6 for n in vocab})


@query("emotion_vector", _emotion_sql(X.EMOTIONS))
def emotion_vector(spark, sf_dir):
    return _emotions(spark, sf_dir, X.EMOTIONS)


@query("emotion_vector_local", _emotion_sql(LOCAL))
def emotion_vector_local(spark, sf_dir):
    return _emotions(spark, sf_dir, LOCAL)


def _sentiment_sql(pos, neg) -> str:
    quoted = lambda v: ", ".join(f"'{w}'" for w in v)
    count = lambda v: f"len(list_filter(w, lambda x: x IN ({quoted(v)})))"
    return f"""
WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
c AS (SELECT doc_id, {count(pos)} AS p, {count(neg)} AS n FROM t),
r AS (SELECT doc_id, (p - n) / (p + n + 1e-8) AS sentiment FROM c)
SELECT doc_id, {rounded_sql({"sentiment": 6})} FROM r"""


def _sentiment(spark, sf_dir, pos, neg):
    docs = views.table(spark, sf_dir, "documents").withColumn("w", X.words(F.col("text")))
    return rounded(docs.select("doc_id", X.keyword_sentiment(F.col("w"), pos, neg).alias("sentiment")), {"sentiment": 6})


@query("keyword_sentiment", _sentiment_sql(X.POSITIVE, X.NEGATIVE))
def keyword_sentiment(spark, sf_dir):
    return _sentiment(spark, sf_dir, X.POSITIVE, X.NEGATIVE)


@query("keyword_sentiment_local", _sentiment_sql(LOCAL_POS, LOCAL_NEG))
def keyword_sentiment_local(spark, sf_dir):
    return _sentiment(spark, sf_dir, LOCAL_POS, LOCAL_NEG)


@query("text_hash", """
SELECT doc_id, substring(md5(text), 1, 12) AS text_hash, sha256(text) AS content_hash FROM documents""")
def text_hash(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", X.text_hash(F.col("text")).alias("text_hash"), X.content_hash(F.col("text")).alias("content_hash"))


@query("usable_text", f"""
SELECT doc_id, length({stripped("text")}) AS chars FROM documents WHERE length({stripped("text")}) >= 10""")
def usable_text(spark, sf_dir):
    from tidemark.operators.normalize import usable_text as usable

    out = usable(views.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.length("body").cast("long").alias("chars"))


STRIPPED = "SELECT page_id, " + stripped(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')""") \
  + " AS body FROM pages"


@query("html_strip", f"""
WITH s AS ({STRIPPED}) SELECT page_id, md5(body) AS body_md5, length(body) AS chars FROM s""")
def html_strip(spark, sf_dir):
    body = views.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))
    return body.select("page_id", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("chars"))


@query("statement_body", rf"""
WITH s AS ({STRIPPED}), e AS (SELECT page_id, body,
  {stripped("regexp_extract(body, '(?s)(The .+?)(?:Nicht|Que )', 1)")} AS part FROM s)
SELECT page_id, md5(CASE WHEN part = '' THEN body ELSE part END) AS statement_md5 FROM e""")
def statement_body(spark, sf_dir):
    body = views.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))
    part = X.statement_body(F.col("body"), "The ", ("Nicht", "Que "))
    return body.select("page_id", F.md5(part).alias("statement_md5"))


def page_order() -> Order:
    return Order((), ("page_id",), F.floor(F.col("page_id") / 4096).cast("long"))


@query("statement_word_changes", f"""
WITH s AS ({STRIPPED}), l AS (SELECT page_id, body, coalesce(lag(body) OVER (ORDER BY page_id), '') AS prev FROM s),
w AS (SELECT page_id, list_filter(list_distinct(string_split(body, ' ')), lambda x: x <> '') AS cur,
             list_filter(list_distinct(string_split(prev, ' ')), lambda x: x <> '') AS old FROM l)
SELECT page_id, len(list_filter(cur, lambda x: NOT list_contains(old, x))) AS added,
  len(list_filter(old, lambda x: NOT list_contains(cur, x))) AS removed FROM w""")
def statement_word_changes(spark, sf_dir):
    body = views.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))
    out = statements.word_changes(body, "body", page_order())
    return out.select("page_id", F.size("added").cast("long").alias("added"),
                      F.size("removed").cast("long").alias("removed"))


_MOODS = ", ".join(f"{n}_share AS {n}" for n in LOCAL)


@query("text_vector", f"""
SELECT doc_id, CAST(5 + 64 AS INTEGER) AS width, sentiment, {_MOODS},
  coalesce(round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * CAST(embedding[i] AS DOUBLE))), 5), 0e0) AS rest
FROM ({_sentiment_sql(LOCAL_POS, LOCAL_NEG)}) s JOIN ({_emotion_sql(LOCAL)}) e USING (doc_id)
LEFT JOIN embeddings ON vec_id = doc_id""")
def text_vector(spark, sf_dir):
    """Sentiment, emotions and a stored embedding (zeros if there is none) of every document, all entries compared."""
    from tidemark.operators.normalize import text_vector as vector

    docs = views.table(spark, sf_dir, "documents").withColumn("w", X.words(F.col("text")))
    emb = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("e"))
    moods = X.with_emotions(docs.select("doc_id", "text", "w"), "text", LOCAL)
    rows = moods.select("doc_id", X.keyword_sentiment(F.col("w"), LOCAL_POS, LOCAL_NEG).alias("sentiment_score"),
                        F.array(*[F.col(f"{n}_share") for n in LOCAL]).alias("emotion_vector")).join(emb, "doc_id", "left")
    rows = rows.withColumn("topic_embedding", F.coalesce("e", F.array_repeat(F.lit(0.0).cast("float"), 64)))
    rest = F.aggregate(F.transform(F.slice("v", 6, 64), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    out = rows.withColumn("v", vector()).select(
        "doc_id", F.size("v").alias("width"), F.get("v", 0).alias("sentiment"),
        *[F.get("v", i).alias(n) for i, n in enumerate(LOCAL, 1)], rest.alias("rest"))
    return rounded(out, {"sentiment": 6, **{n: 6 for n in LOCAL}, "rest": 5})
