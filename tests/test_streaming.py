"""Streams give what the batch operators give on the same rows."""

import os
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import views
from tidemark.operators import bars, normalize, scans, ticks
from tidemark.operators.blocks import ticks_order
from tidemark.sources.lake import Lake
from tidemark.streaming import jobs, sinks


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """Ticks in eight files, in time order."""
    path = str(tmp_path_factory.mktemp("ticks"))
    rows = views.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    return in_order(path)


def in_order(path):
    """Give the files increasing ages: the file source reads the oldest first."""
    for i, f in enumerate(sorted(pathlib.Path(path).glob("part-*.parquet"))):
        os.utime(f, (1_600_000_000 + i * 60,) * 2)
    return path


def stream(spark, path, schema=None):
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(path)


def drained(df, tmp_path, name, mode="append"):
    """Run a stream to the end of its input and read what it wrote."""
    spark, out = df.sparkSession, str(tmp_path / name)
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.read.parquet(out)


def test_candles(spark, landed, tmp_path):
    batch = bars.candles(spark.read.parquet(landed), "1 hour").toPandas()
    got = drained(jobs.candle_stream(stream(spark, landed), "1 hour"), tmp_path, "candles").toPandas()
    both = got.merge(batch, on=["symbol", "t"], suffixes=("", "_b"))
    assert len(both) == len(got) > 0.9 * len(batch)  # windows still open at the end are not emitted
    for c in ("open", "high", "low", "close", "volume"):
        np.testing.assert_allclose(both[c], both[f"{c}_b"])


def test_dedup(spark, landed, tmp_path):
    src = stream(spark, landed).select("ts", F.col("mid").alias("k"))
    got = drained(jobs.dedup_stream(src, "k", within="60 days"), tmp_path, "dedup")
    assert got.count() == got.select("k").distinct().count() == spark.read.parquet(landed).select("mid").distinct().count()


def test_normalise(spark, landed, tmp_path):
    def raw(df):
        payload = F.to_json(F.struct("symbol", "mid", "volume"))
        return df.select("event_id", F.unix_seconds("ts").cast("double").alias("timestamp"), F.lit("market").alias("type"),
                         payload.alias("payload"), F.lit("s").alias("source"), F.lit(1.0).alias("confidence"))

    batch = normalize.route(raw(spark.read.parquet(landed)))["market"]
    got = drained(jobs.normalise(raw(stream(spark, landed)))["market"], tmp_path, "norm")
    assert got.select(*batch.columns).exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_symbol_state_equals_batch(spark, landed, tmp_path):
    base = spark.read.parquet(landed)
    src = stream(spark, landed).select(
        "symbol", (F.unix_micros("ts") / 1e6).alias("ts"), "event_id", "mid", "volume", (F.col("volume") / 97).alias("obs"))
    got = drained(jobs.symbol_state(src), tmp_path, "state").toPandas().sort_values("event_id").reset_index(drop=True)
    order = ticks_order()
    want = ticks.tick_indicators(base).select("event_id", "macd", "macd_signal")
    want = want.join(ticks.rolling_robust_z(base).select("event_id", "z_price"), "event_id")
    g = scans.carried_scan(ticks.log_returns(base).select("event_id", "symbol", "rn", "log_ret"), scans.garch_scan(), order)
    want = want.join(g.select("event_id", "sigma"), "event_id")
    c = scans.kalman_confidence(base.withColumn("obs", F.col("volume") / 97), "obs", order)
    want = want.join(c.select("event_id", "confidence"), "event_id")
    s = ticks.numbered_ticks(base).select("event_id", "symbol", "rn", (F.unix_micros("ts") / 1e6).alias("seconds"), "mid", "volume")
    want = want.join(scans.carried_scan(s, scans.session_scan(), order).select("event_id", "vwap_dev"), "event_id")
    want = want.toPandas().sort_values("event_id").reset_index(drop=True)
    assert (got["event_id"] == want["event_id"]).all()
    for col in jobs.INDICATORS:
        np.testing.assert_allclose(got[col], want[col], rtol=1e-7, atol=1e-9, err_msg=col)


def test_delayed_settlement(spark, landed, tmp_path):
    from tidemark.operators.align import tick_horizon

    src = stream(spark, landed).withColumn("pred", F.lit(0.01)).select("symbol", "ts", "event_id", "mid", "pred")
    got = drained(jobs.delayed_settlement(src), tmp_path, "settle").toPandas()
    batch = tick_horizon(ticks.numbered_ticks(spark.read.parquet(landed)), (5, 30), ticks_order()).toPandas()
    for h in (5, 30):
        a = got[got["horizon"] == h].set_index("event_id")["realised"].sort_index()
        b = batch.set_index("event_id")[f"realised_{h}"].dropna().sort_index()
        pd.testing.assert_series_equal(a, b, check_names=False)


def test_change_only(spark, tmp_path):
    src = str(tmp_path / "obs")
    rows = [("A", 1, 5.0), ("A", 2, 5.0), ("A", 3, None), ("B", 1, 1.0), ("A", 4, 6.0), ("B", 2, 2.0), ("A", 5, 6.0)]
    spark.createDataFrame(rows, "series_id string, date int, value double").repartitionByRange(3, "date").write.parquet(src)
    in_order(src)
    out = drained(jobs.changed_values(stream(spark, src)), tmp_path, "changed").toPandas()
    assert sorted(out.itertuples(index=False, name=None)) == [("A", 1, 5.0), ("A", 4, 6.0), ("B", 1, 1.0), ("B", 2, 2.0)]


def test_fusion(spark, landed, tmp_path):
    t = stream(spark, landed)
    feed = t.where("volume > 80").select("symbol", "ts", F.col("volume").alias("value"))
    rows = jobs.fusion_rows(t, {"macro": feed})
    got = drained(jobs.latest_value_stream(rows, ["macro"]), tmp_path, "fusion").toPandas().sort_values("event_id")
    pdf = spark.read.parquet(landed).toPandas().sort_values("ts")
    macro = pdf["volume"].where(pdf["volume"] > 80)
    want = macro.groupby(pdf["symbol"]).ffill()
    want.index = pdf["event_id"]
    np.testing.assert_allclose(got["macro"], want.sort_index())


def test_news_sink_and_snapshot(spark, tmp_path):
    src = str(tmp_path / "raw")
    rows = [(float(i), "news", f'{{"url": "u{i % 4}", "title": "t{i}"}}', "s", 1.0) for i in range(8)]
    rows += [(9.0, "news", '{"url": "x"}', "s", 1.0), (9.0, "market", "{}", "s", 1.0)]
    raw = spark.createDataFrame(rows, "timestamp double, type string, payload string, source string, confidence double")
    raw.union(raw).repartition(4).write.parquet(src)
    lake = Lake(spark, str(tmp_path / "lake"))
    q = sinks.start_news_sink(stream(spark, src), lake, str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(300)
    assert lake.read("news").count() == 8
    snap = str(tmp_path / "snap")
    typed = stream(spark, src).select("source", "timestamp", "type")
    q = sinks.start_snapshot_sink(typed, ["type"], "timestamp", snap, str(tmp_path / "cp2"), {"availableNow": True})
    q.awaitTermination(300)
    got = {r["type"]: r["timestamp"] for r in sinks.latest_snapshot(spark, snap).collect()}
    assert got == {"news": 9.0, "market": 9.0}


def test_landings_are_bounded_and_in_order(spark, tmp_path):
    """A batch of a stream with state holds about as many rows as asked for, whatever the input holds."""
    from tidemark.catalog import streams

    rows = [(float(i * 7919 % 5000 // 2), i) for i in range(5000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "at double, i long").repartition(5)
    batches = []

    def start(source, base):
        def keep(batch, _epoch):
            batches.append([tuple(r) for r in batch.collect()])

        return (source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint")
                .trigger(availableNow=True).start())

    streams.streamed(df, "at", start, rows=600)
    assert len(batches) == 9 and max(map(len, batches)) < 700
    assert sorted(r for b in batches for r in b) == sorted(rows[:-1])
    assert all(max(a)[0] < min(b)[0] for a, b in zip(batches, batches[1:]))


def test_steps_pass_on_results_in_chunks(spark, landed, tmp_path, monkeypatch):
    src = stream(spark, landed).select(
        "symbol", (F.unix_micros("ts") / 1e6).alias("ts"), "event_id", "mid", "volume", (F.col("volume") / 97).alias("obs"))
    whole = drained(jobs.symbol_state(src), tmp_path, "whole")
    monkeypatch.setattr(jobs, "CHUNK", 7)
    chunked = drained(jobs.symbol_state(src), tmp_path, "chunked")
    assert chunked.count() == whole.count() > 0 and chunked.exceptAll(whole).count() == 0


def test_upsert_moves_only_keys_of_its_batch(spark, tmp_path, monkeypatch):
    """Rows of a batch are chosen without gathering them by key; the last of each key wins, over several bitmaps."""
    from tidemark.sources import lake as lakes

    monkeypatch.setattr(lakes, "dedup_by_max", None)
    rows = spark.range(0, 80_000, 1, 2).select(
        F.when(F.col("id") % 1000 > 0, F.concat(F.lit("k"), F.col("id") % 30_000)).alias("id"), F.col("id").cast("string").alias("title"))
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.upsert("news", rows.where("title < '5'"))
    lake.upsert("news", rows)
    pdf = rows.toPandas()
    want = pdf.groupby("id", dropna=False)["title"].last()
    got = lake.read("news").select("id", "title").toPandas()
    known = got[got["id"].notna()].set_index("id")["title"].sort_index()
    pd.testing.assert_series_equal(known, want[want.index.notna()].sort_index(), check_names=False)
    none = sorted(got.loc[got["id"].isna(), "title"], key=int)  # a null key equals no stored one
    assert none[-1] == "79000" and len(none) == 2
    plan = lakes.last_rows(rows.withColumn("n", F.monotonically_increasing_id()), ["id"], "n")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "max_by" not in plan


def news_files(lake):
    return {p.relative_to(lake.path("news")): p.stat().st_mtime_ns for p in pathlib.Path(lake.path("news")).rglob("part-*.parquet")}


def test_upsert_holds_no_rows_and_leaves_partitions_without_its_keys(spark, tmp_path, monkeypatch):
    """Rows of a batch are never cached; only partitions that hold one of its keys are written anew."""
    def fails(*_args, **_kw):
        raise AssertionError("rows held in memory")

    for name in ("persist", "cache"):
        monkeypatch.setattr(type(spark.range(1)), name, fails)
    lake = Lake(spark, str(tmp_path / "lake"))

    def rows(start, end, title):
        return spark.range(start, end, 1, 2).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(title).alias("title"))

    twice = rows(0, 2000, "a").unionByName(rows(0, 2000, "b"))
    twice.write.parquet(str(tmp_path / "landed"))
    q = (spark.readStream.schema(twice.schema).parquet(str(tmp_path / "landed")).writeStream
         .foreachBatch(lambda batch, _epoch: lake.upsert("news", batch))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    first = news_files(lake)
    assert lake.read("news").count() == lake.read("news").select("id").distinct().count() == 2000
    lake.upsert("news", rows(2000, 2500, "c"))
    second = news_files(lake)
    assert first.items() < second.items()
    lake.upsert("news", rows(7, 8, "d").unionByName(rows(2500, 2600, "d")))
    third = news_files(lake)
    gone = second.keys() - third.keys()
    assert len({p.parent for p in gone}) == 1 and second.items() - third.items() == {(p, second[p]) for p in gone}
    got = {r["id"]: r["title"] for r in lake.read("news").collect()}
    assert len(got) == lake.read("news").count() == 2600
    assert {t: list(got.values()).count(t) for t in "cd"} == {"c": 500, "d": 101} and got["k7"] == "d"
    assert list((tmp_path / "lake" / "_aside").iterdir()) == []


def test_upsert_merges_many_small_files(spark, tmp_path, monkeypatch):
    from tidemark.sources import lake as lakes

    monkeypatch.setattr(lakes, "MANY_FILES", 3)
    lake = Lake(spark, str(tmp_path / "lake"))
    most = []
    for i in range(5):
        lake.upsert("news", spark.range(i * 2000, i * 2000 + 2000, 1, 2).select(F.concat(F.lit("k"), "id").alias("id")))
        parts = [p.parent for p in news_files(lake)]
        most.append(max(parts.count(p) for p in parts))
    assert max(most) > 3 > most[-1]
    assert lake.read("news").count() == lake.read("news").select("id").distinct().count() == 10_000


def test_upsert_of_rows_that_differ_when_read_again(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.upsert("news", spark.range(0, 500, 1, 4).select(F.expr("uuid()").alias("id"), F.lit(None).alias("title")))
    assert lake.read("news").count() == 500
    undated = spark.createDataFrame([(None, "S1", 1.0)], "date date, series_id string, value double")
    for _ in range(2):
        lake.upsert("macro_d", undated)
    assert lake.read("macro_d").count() == 1
