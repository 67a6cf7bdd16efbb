"""Domain views over the supplied parquet tables: ticks, daily prices, macro, positioning, flows, news.

Each view exists twice with the same content: as a DataFrame and as the SQL text (`SQL`) that the
registered checks start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOL_OF_PRIORITY = {"1-URGENT": "GC=F", "2-HIGH": "DX-Y.NYB", "3-MEDIUM": "^VIX", "4-NOT SPECIFIED": "SLV"}
SERIES_OF_FLAG = {"AO": "DFII10", "NO": "T10YIE", "RF": "DGS10", "NF": "DGS2", "AF": "FEDFUNDS"}

SQL = {
    "ticks": """
SELECT event_id, ts, concat('S', user_id % 5) AS symbol, value AS mid,
       value * 5e-4 * (1 + event_id % 5) AS spread, CAST(event_id % 97 AS DOUBLE) AS volume
FROM events WHERE value > 0""",
    "prices_d": """
SELECT CAST(o_orderdate AS DATE) AS date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'GC=F' WHEN '2-HIGH' THEN 'DX-Y.NYB'
            WHEN '3-MEDIUM' THEN '^VIX' WHEN '4-NOT SPECIFIED' THEN 'SLV' ELSE 'CL=F' END AS symbol,
       min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2""",
    "macro_d": """
SELECT CAST(l_shipdate AS DATE) AS date,
       CASE concat(l_returnflag, l_linestatus) WHEN 'AO' THEN 'DFII10' WHEN 'NO' THEN 'T10YIE'
            WHEN 'RF' THEN 'DGS10' WHEN 'NF' THEN 'DGS2' WHEN 'AF' THEN 'FEDFUNDS' ELSE 'VIXCLS' END AS series_id,
       round(avg(l_discount) * 1e2, 6) AS value
FROM lineitem GROUP BY 1, 2""",
    "cot_disagg": """
SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS report_date, 'GOLD_COMEX' AS contract,
       CAST(count(*) AS DOUBLE) AS open_interest,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0e0 END), 2) AS mm_long,
       round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0e0 END), 2) AS mm_short
FROM orders GROUP BY 1, 2""",
    "etf_holdings": """
SELECT CAST(l_shipdate AS DATE) AS date, 'GLD' AS ticker,
       sum(l_quantity) / 1e3 AS holdings_tonnes, sum(l_quantity) AS shares_out,
       round(avg(l_extendedprice / l_quantity), 6) AS nav
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    "news": """
SELECT concat('n', doc_id) AS id,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '17' MINUTE AS ts,
       source, concat('http://x/', doc_id) AS url, text AS title, text
FROM documents""",
    "news_features": """
SELECT concat('n', doc_id) AS news_id, 'v1' AS model_version,
       ((doc_id * 37) % 201 - 100) / 1e2 AS gold_impact,
       ((doc_id * 53) % 101) / 1e2 AS confidence,
       quality = 1 AS novel
FROM labels""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(value: Column, mapping: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, name in mapping.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("value") > 0)
    return e.select(
        "event_id", "ts", F.concat(F.lit("S"), F.col("user_id") % 5).alias("symbol"),
        F.col("value").alias("mid"),
        (F.col("value") * 5e-4 * (1 + F.col("event_id") % 5)).alias("spread"),
        (F.col("event_id") % 97).cast("double").alias("volume"))


def prices_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return (table(spark, sf_dir, "orders")
            .groupBy(F.to_date("o_orderdate").alias("date"),
                     _mapped(F.col("o_orderpriority"), SYMBOL_OF_PRIORITY, "CL=F").alias("symbol"))
            .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, key).alias("close"), F.count("*").cast("double").alias("volume")))


def macro_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.to_date("l_shipdate").alias("date"),
                     _mapped(F.concat("l_returnflag", "l_linestatus"), SERIES_OF_FLAG, "VIXCLS").alias("series_id"))
            .agg(F.round(F.avg("l_discount") * 100.0, 6).alias("value")))


def cot_disagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(status: str) -> Column:
        hit = F.col("o_orderstatus") == status
        return F.round(F.sum(F.when(hit, F.col("o_totalprice")).otherwise(0.0)), 2)

    return (table(spark, sf_dir, "orders")
            .groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("report_date"),
                     F.lit("GOLD_COMEX").alias("contract"))
            .agg(F.count("*").cast("double").alias("open_interest"),
                 part("F").alias("mm_long"), part("O").alias("mm_short")))


def etf_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
            .groupBy(F.to_date("l_shipdate").alias("date"), F.lit("GLD").alias("ticker"))
            .agg((F.sum("l_quantity") / 1000.0).alias("holdings_tonnes"),
                 F.sum("l_quantity").alias("shares_out"),
                 F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("nav")))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("n"), "doc_id").alias("id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '17' MINUTE").alias("ts"),
        "source", F.concat(F.lit("http://x/"), "doc_id").alias("url"),
        F.col("text").alias("title"), "text")


def news_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("n"), i).alias("news_id"), F.lit("v1").alias("model_version"),
        (((i * 37) % 201 - 100) / 100.0).alias("gold_impact"),
        (((i * 53) % 101) / 100.0).alias("confidence"), (F.col("quality") == 1).alias("novel"))
