"""Micro-batch sinks: news upserts, latest snapshots, packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import head, news_id, strip
from tidemark.sources.lake import Lake

NEWS = "url string, title string, text string"


def news_rows(raw: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """Rows of the news table from raw news and sentiment events; events without any text are dropped.

    `widths` cuts the columns url, source, title, text and raw_json that it names; the others are kept whole.
    """
    most = (widths or {}).get
    m = raw.where(F.col("type").isin("news", "sentiment")).withColumn("m", F.from_json("payload", NEWS))

    def cut(name: str) -> Column:
        return head(strip(F.coalesce(F.col(f"m.{name}"), F.lit(""))), most(name)).alias(name)

    rows = m.select("timestamp", "source", "payload", cut("url"), cut("title"), cut("text"))
    rows = rows.where((F.col("title") != "") | (F.col("text") != ""))
    fallback = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("text"))
    return rows.select(
        news_id(F.col("url"), F.floor("timestamp"), fallback).alias("id"),
        F.timestamp_seconds("timestamp").alias("ts"), head(F.col("source"), most("source")).alias("source"),
        "url", "title", "text", head(F.col("payload"), most("raw_json")).alias("raw_json"))


def start_news_sink(raw: DataFrame, lake: Lake, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upsert news into the lake once a second; replaying a batch gives the same table."""
    def write(batch: DataFrame, _epoch: int) -> None:
        lake.upsert("news", batch)

    return (news_rows(raw).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def start_snapshot_sink(df: DataFrame, keys: list[str], at: str, path: str, checkpoint: str,
                        trigger: dict | None = None) -> StreamingQuery:
    """Keep the newest row per key in a table: each version is a new folder, named by its epoch."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(at)).alias("r")).select("r.*")
        versions = _versions(spark, path, before=epoch)
        if versions:
            old = spark.read.schema(batch.schema).parquet(f"{path}/{versions[-1]}")
            newer = old.unionByName(newest)
            newest = newer.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(at)).alias("r")).select("r.*")
        newest.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/epoch={epoch:012d}")

    return (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def _versions(spark, path: str, before: int | None = None) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("epoch="))
    done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return [n for n in done if before is None or int(n.split("=")[1]) < before]


def latest_snapshot(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")


def start_callback(df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str,
                   trigger: dict | None = None) -> StreamingQuery:
    """Hand each micro-batch to a user function."""
    return (df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def packet_json(df: DataFrame) -> DataFrame:
    """One JSON packet per tick with rounded numbers; map columns are map<string,double> (prediction nests)."""
    def rounded_map(name: str) -> Column:
        return F.transform_values(F.col(name), lambda _k, v: F.round(v, 4)).alias(name)

    fields = [F.round("price", 5).alias("price")]
    for name in ("prediction",):
        if name in df.columns:
            fields.append(F.col(name))
    fields += [rounded_map(n) for n in ("world_state", "causal", "attention") if n in df.columns]
    fields += [F.round("confidence", 4).alias("confidence"), F.col("regime")]
    if "memory" in df.columns:
        fields.append(F.slice("memory", 1, 3).alias("memory"))
    fields.append(F.col("ts"))
    keep = [c for c in ("symbol", "event_id") if c in df.columns]
    return df.select(*keep, F.to_json(F.struct(*fields)).alias("packet"))
