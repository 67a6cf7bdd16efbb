"""Similarity queries: memory search by label prototypes, analogue days, pattern memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views
from tidemark.catalog.daily import dated, panel_sql, stored_panel
from tidemark.operators import similarity as S
from tidemark.operators import ticks as T
from tidemark.operators.blocks import ticks_order

FEATURES = ["gold_logret_1d", "gold_logret_5d", "gold_logret_20d", "vix_z", "dxy_z", "gold_yz_20", "tips_z",
            "cot_mm_net_z", "gld_flow_5d_z", "news_impact"]
ASOF = "2001-03-01"
CUTOFF = "2001-01-30"  # thirty days before


def prototypes(spark, sf_dir):
    """One query per label: the mean vector of its members."""
    e = views.table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(  # one row per vector position
        F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


@query("memory_topk", f"""
WITH p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
q AS (SELECT label, list(x ORDER BY i) AS v FROM p GROUP BY label),
s AS (SELECT q.label AS query_id, e.vec_id, list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])) AS similarity
      FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, {rounded_sql({"similarity": 6})} FROM r WHERE rank <= 5""")
def memory_topk(spark, sf_dir):
    memory = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = prototypes(spark, sf_dir).withColumnRenamed("label", "query_id")
    out = S.top_k_similar(q, memory, 5).withColumn("rank", F.col("rank").cast("long"))
    return rounded(out, {"similarity": 6})


def scaled_ctes() -> str:
    med = ", ".join(f"median(coalesce({c}, 0e0)) AS m_{c}" for c in FEATURES)
    mad = ", ".join(f"1.4826e0 * median(abs(coalesce({c}, 0e0) - m_{c})) AS d_{c}" for c in FEATURES)
    scaled = ", ".join(
        f"greatest(-8e0, least(8e0, (coalesce({c}, 0e0) - m_{c}) / CASE WHEN d_{c} < 1e-8 THEN 1e0 ELSE d_{c} END))"
        for c in FEATURES)
    present = " OR ".join(f"{c} IS NOT NULL" for c in FEATURES)
    return f""",
base AS (SELECT * FROM panel WHERE target_logret_20d IS NOT NULL AND ({present})),
med AS (SELECT {med} FROM base), mad AS (SELECT {mad} FROM base, med),
sv AS (SELECT date, gold_close, target_logret_20d AS target_logret, vix_close, [{scaled}] AS v FROM base, med, mad),
idx AS (SELECT * EXCLUDE (v), list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v FROM sv),
qr AS (SELECT [{scaled}] AS v, vix_close AS q_vix FROM panel, med, mad
       WHERE date <= DATE '{ASOF}' ORDER BY date DESC LIMIT 1),
qv AS (SELECT list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS q, q_vix FROM qr),
hits AS (SELECT idx.date, gold_close, target_logret, list_dot_product(v, q) AS similarity FROM idx, qv
  WHERE idx.date <= DATE '{CUTOFF}' AND (coalesce(q_vix <= 0, true) OR vix_close BETWEEN q_vix * 0.65e0 AND q_vix * 1.35e0)
  ORDER BY similarity DESC, idx.date LIMIT 10)"""


def analogues(spark, sf_dir):
    from tidemark.plans.analogues import analogues_of

    return analogues_of(stored_panel(spark, sf_dir), FEATURES, "target_logret_20d", ASOF, k=10)


@query("analogue_topk", panel_sql(scaled_ctes() + f"""
SELECT CAST(date AS VARCHAR) AS date, gold_close, {rounded_sql({"target_logret": 6, "similarity": 6})} FROM hits"""))
def analogue_topk(spark, sf_dir):
    out = analogues(spark, sf_dir).select("date", "gold_close", "target_logret", "similarity")
    return dated(rounded(out, {"target_logret": 6, "similarity": 6}))


_SUMMARY = {c: 6 for c in ("mean", "median", "std", "p_up", "q10", "q90", "avg_sim")}


@query("analogue_summary", panel_sql(scaled_ctes() + f""",
r AS (SELECT count(*) AS n, avg(target_logret) AS mean, median(target_logret) AS median, stddev_pop(target_logret) AS std,
  avg(CASE WHEN target_logret > 0 THEN 1 ELSE 0 END) AS p_up, quantile_cont(target_logret, 0.1) AS q10,
  quantile_cont(target_logret, 0.9) AS q90, avg(similarity) AS avg_sim FROM hits)
SELECT n, {rounded_sql(_SUMMARY)} FROM r"""))
def analogue_summary(spark, sf_dir):
    return rounded(S.outcome_summary(analogues(spark, sf_dir)), _SUMMARY)


ENTRIES = {f"v{i}": 6 for i in range(1, len(FEATURES) + 1)}


@query("analogue_index", panel_sql(scaled_ctes() + f""",
r AS (SELECT date, {", ".join(f"v[{i}] AS v{i}" for i in range(1, len(FEATURES) + 1))} FROM idx)
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql(ENTRIES)} FROM r"""))
def analogue_index(spark, sf_dir):
    index = S.build_index(stored_panel(spark, sf_dir), FEATURES, "target_logret_20d")
    out = index.select("date", *[F.get("vector", i).alias(name) for i, name in enumerate(ENTRIES)])
    return dated(rounded(out, ENTRIES))


@query("pattern_memory_rows", with_views(["ticks"], f"""
r AS (SELECT event_id, symbol, ln(lead(mid, 30) OVER w / mid) AS outcome,
    mid / (sqrt(mid * mid + spread * spread + volume * volume) + 1e-12) AS v1,
    volume / (sqrt(mid * mid + spread * spread + volume * volume) + 1e-12) AS v3,
    concat('t=', CAST(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS VARCHAR)) AS label
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))
SELECT event_id, symbol, label, {rounded_sql({"outcome": 6, "v1": 6, "v3": 6})} FROM r WHERE outcome IS NOT NULL"""))
def pattern_memory_rows(spark, sf_dir):
    t = T.numbered_ticks(views.ticks(spark, sf_dir)).withColumn("context", F.array("mid", "spread", "volume"))
    out = S.pattern_rows(t, "context", 30, ticks_order())
    out = out.select("event_id", "symbol", "label", "outcome", F.get("vector", 0).alias("v1"),
                     F.get("vector", 2).alias("v3"))
    return rounded(out, {"outcome": 6, "v1": 6, "v3": 6})
