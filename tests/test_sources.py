"""Feed and history parsers on sample messages, lake tables, news replies, dossier."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.streaming import sinks
from tidemark.operators import bars, macro, normalize, statements
from tidemark.operators.blocks import Order
from tidemark.plans import dossier, news, settle
from tidemark.sources import feeds, history
from tidemark.sources.lake import Lake, upsert_rows


def lines(spark, *messages, **extra):
    rows = [(m if isinstance(m, str) else json.dumps(m), *extra.values()) for m in messages]
    return spark.createDataFrame(rows, ["line", *extra])


def payloads(df):
    return [r["payload"].asDict() for r in df.collect()]


def test_tick_messages(spark):
    df = lines(spark, {"event": "price", "timestamp": 10, "symbol": "XAU/USD", "price": 100.5},
               {"event": "price", "timestamp": 11, "price": 101, "bid": 100, "ask": 102, "day_volume": 7},
               {"event": "heartbeat"}, "not json")
    a, b = payloads(feeds.tick_messages(df))
    assert (a["bid"], a["ask"], a["spread"], a["volume"]) == (100.5, 100.5, 0.0, 0.0)
    assert (b["symbol"], b["spread"], b["volume"]) == ("XAU/USD", 2.0, 7.0)


def test_rate_and_broker(spark):
    rate = {"Realtime Currency Exchange Rate": {"5. Exchange Rate": "2000.5", "8. Bid Price": "2000"}}
    got = payloads(feeds.rate_quotes(lines(spark, rate, {"Note": "slow down"}, received_at=5.0)))
    assert len(got) == 1 and got[0]["ask"] == 2000.5 and got[0]["spread"] == 0.5
    price = {"type": "PRICE", "time": "7.5", "bids": [{"price": "10"}], "asks": [{"price": "12"}], "tradeable": False}
    row = feeds.broker_prices(lines(spark, price, {"type": "HEARTBEAT"})).collect()
    assert len(row) == 1 and row[0]["timestamp"] == 7.5 and row[0]["payload"]["mid"] == 11 and not row[0]["payload"]["tradeable"]


def test_article_feeds(spark):
    ok = {"status": "ok", "articles": [
        {"title": " Gold up ", "description": None, "url": "u1", "publishedAt": "2024-01-02T03:04:05+01:00", "source": {"name": "s"}},
        {"title": None, "description": "d", "url": "u2", "publishedAt": "never"}]}
    rows = feeds.news_articles(lines(spark, ok, {"status": "error"})).collect()
    assert [r["payload"]["text"] for r in rows] == ["Gold up", "d"]
    assert rows[0]["timestamp"] == dt.datetime(2024, 1, 2, 2, 4, 5, tzinfo=dt.timezone.utc).timestamp()
    good, bad = feeds.quarantine(feeds.news_articles(lines(spark, ok)))
    assert good.count() == 1 and bad.first()["payload"]["url"] == "u2"
    g = feeds.gdelt_articles(lines(spark, {"articles": [{"title": "t", "url": "u", "seendate": "20240102030405"}]})).first()
    assert g["timestamp"] == dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc).timestamp()


def test_posts(spark):
    new = {"id": "a", "title": "T", "selftext": "x" * 600, "subreddit": "gold", "permalink": "/p", "created_utc": 900.0}
    old = {**new, "id": "b", "created_utc": 100.0}
    rows = feeds.forum_posts(lines(spark, new, old, received_at=1000.0), poll_seconds=60).collect()
    assert [r["payload"]["post_id"] for r in rows] == ["a"] and rows[0]["source"] == "reddit/gold"
    assert len(rows[0]["payload"]["text"]) == 2 + 600
    cut = feeds.forum_posts(lines(spark, new, received_at=1000.0), poll_seconds=60, title_width=512, body_width=500).first()
    assert len(cut["payload"]["text"]) == 2 + 500
    posts = {"data": [{"id": "5", "text": "hi", "public_metrics": {"like_count": 3}}, {"id": "9", "text": "yo"}]}
    got = payloads(feeds.short_posts(lines(spark, posts), since_id=5))
    assert [(p["tweet_id"], p["likes"]) for p in got] == [("9", 0)]


def test_union_of_feeds(spark):
    a = feeds.tick_messages(lines(spark, {"event": "price", "timestamp": 1, "price": 5}))
    b = feeds.gdelt_articles(lines(spark, {"articles": [{"title": "t", "url": "u", "seendate": "20240102030405"}]}))
    both = feeds.unite(a, b).collect()
    assert {r["type"] for r in both} == {"market", "news"} and all(json.loads(r["payload"]) for r in both)


def test_macro_and_positioning_files(spark, tmp_path):
    reply = {"series_id": "DGS10", "observations": [
        {"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "4.1"}, {"date": "bad", "value": "1"}]}
    assert [tuple(r) for r in history.macro_observations(lines(spark, reply)).collect()] == [
        (dt.date(2024, 1, 2), "DGS10", 4.1)]
    (tmp_path / "2019.csv").write_text(
        "CFTC_Contract_Market_Code,Report_Date_as_YYYY-MM-DD,Open_Interest_All,M_Money_Positions_Long_All,Swap__Positions_Short_All\n"
        "088691 ,2019-01-01,10,5,x\n088691,bad,1,1,1\n067651,2019-01-01,9,9,9\n")
    (tmp_path / "2020.csv").write_text(
        "CFTC Contract Market Code,Report_Date_as_MM_DD_YYYY,Open_Interest_All\n088691,02/03/2020,11\n")
    got = history.read_positioning(spark, [str(tmp_path / f"{y}.csv") for y in (2019, 2020)]).orderBy("report_date").collect()
    assert [(r["report_date"], r["open_interest"], r["mm_long"], r["swap_short"]) for r in got] == [
        (dt.date(2019, 1, 1), 10.0, 5.0, None), (dt.date(2020, 2, 3), 11.0, None, None)]


def test_fund_and_bars(spark):
    wide = spark.createDataFrame([("02-Jan-2024", "10", "100", "5"), ("03-Jan-2024", "11", "120", "6"), ("HOLIDAY", "", "", "")],
                                 ["Date", " Tonnes of Gold", "Total Shares", "NAV/GLD"])
    got = history.fund_holdings(wide).orderBy("date").collect()
    assert [(r["aum_usd"], r["flow_usd"]) for r in got] == [(500.0, None), (720.0, 120.0)]
    bars_ = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0, 2.0)], ["date", "GC=F|Open", "GC=F|Close"])
    row = history.long_bars(bars_, ["GC=F", "SLV"]).collect()
    assert len(row) == 1 and (row[0]["symbol"], row[0]["close"], row[0]["high"]) == ("GC=F", 2.0, None)


def test_statements(spark):
    page = "<p>Information received since <b>May</b></p><script>x</script> it rose. Voting for this"
    df = spark.createDataFrame([(1, page), (2, page.replace("rose", "fell"))], ["d", "html"])
    out = df.withColumn("s", text.statement_body(text.strip_html(F.col("html"))))
    order = Order((), ("d",), F.lit(0).cast("long"))
    changes = statements.word_changes(out, "s", order).orderBy("d").collect()
    assert changes[1]["s"] == "Information received since May it fell."
    assert changes[1]["added"] == ["fell."] and changes[1]["removed"] == ["rose."]


def test_widths_cut_only_when_they_are_given(spark):
    long = "w" * 60_000
    raw = spark.createDataFrame([(1.0, "news", json.dumps({"title": long, "text": long, "url": "u"}), long, 1.0),
                                 (2.0, "sentiment", json.dumps({"title": "t", "text": long}), "s", 1.0)],
                                "timestamp double, type string, payload string, source string, confidence double")
    row, cut = normalize.news(raw).first(), normalize.news(raw, 512, 1024).first()
    assert (row.title, row.text, len(cut.title), len(cut.text)) == (long, long, 512, 1024)
    assert len(normalize.sentiment(raw).first().text) == 60_002 and len(normalize.sentiment(raw, 512, 1024).first().text) == 1024
    row = sinks.news_rows(raw).where("url = 'u'").first()
    cut = sinks.news_rows(raw, {"title": 512, "text": 8192, "source": 64}).where("url = 'u'").first()
    assert row.text == row.source == long and (len(cut.title), len(cut.text), len(cut.source)) == (512, 8192, 64)
    body = spark.createDataFrame([(long,)], "t string").select(text.statement_body(F.col("t")).alias("b"),
                                                               text.statement_body(F.col("t"), width=9).alias("c")).first()
    assert (body.b, body.c) == (long, long[:9])


def test_routing_keeps_bad_rows_aside(spark):
    raw = spark.createDataFrame([
        (1.0, "market", json.dumps({"mid": 10, "bid": 9, "volume": -3}), "s", 1.0),
        (2.0, "market", json.dumps({"mid": "n/a"}), "s", 1.0), (3.0, "other", "{}", "s", 1.0),
        (4.0, "sentiment", json.dumps({"title": " a ", "text": "b", "score": "x"}), "s", 1.0),
        (5.0, "macro", json.dumps({"event": "CPI", "value": ".", "country": "us"}), "s", 1.0)],
        "timestamp double, type string, payload string, source string, confidence double")
    out = normalize.route(raw)
    m = out["market"].collect()
    assert len(m) == 1 and (m[0]["mid"], m[0]["spread"], m[0]["volume"]) == (9.5, 1.0, 0.0)
    assert sorted(r["timestamp"] for r in out["rejected"].collect()) == [2.0, 3.0, 4.0]
    c = out["macro"].first()
    assert (c["series_id"], c["value"], c["country"]) == ("CPI", None, "US")


def test_logical_clock_equals_loop(spark):
    stamps = [5, 3, 3, 10, 2, 2, 2, 2, 2, 2, 11, 40]
    df = spark.createDataFrame([(i, dt.datetime.fromtimestamp(s / 1000, dt.timezone.utc)) for i, s in enumerate(stamps)],
                               "event_id long, ts timestamp")
    got = [r["logical_t"] for r in bars.logical_clock(df).orderBy("event_id").collect()]
    want, t = [], 0
    for s in stamps:
        t = max(t, s) + 1
        want.append(t)
    assert got == want


def test_surprise_history_skips_given(spark):
    rows = [("S", i, float(v), g) for i, (v, g) in enumerate([(1, None), (3, None), (100, 0.5), (5, None)])]
    got = macro.surprise(spark.createDataFrame(rows, "series_id string, date int, value double, g double"), given="g")
    got = [r["surprise"] for r in got.orderBy("date").collect()]
    assert got[:2] == [None, None] and got[2] == 0.5 and got[3] == pytest.approx((5 - 2) / (1 + 1e-8))


def test_upsert_semantics(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, x string, y double")
    batch = spark.createDataFrame([(2, "c"), (3, "d"), (2, "e")], "id int, x string")
    got = {r["id"]: (r["x"], r["y"]) for r in upsert_rows(target, batch.coalesce(1), ["id"]).collect()}
    assert got == {1: ("a", 1.0), 2: ("e", 2.0), 3: ("d", None)}
    keys_only = upsert_rows(target, batch.select("id"), ["id"])
    assert {r["id"]: r["x"] for r in keys_only.collect()} == {1: "a", 2: "b", 3: None}


def test_lake_tables(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    day = lambda s: dt.date.fromisoformat(s)
    rows = [(day("2019-12-31"), "S1", 1.0), (day("2020-01-02"), "S1", 2.0)]
    lake.upsert("macro_d", spark.createDataFrame(rows, "date date, series_id string, value double"))
    lake.upsert("macro_d", spark.createDataFrame([(day("2020-01-02"), "S1", 9.0), (day("2020-01-03"), "S1", 3.0)],
                                                 "date date, series_id string, value double"))
    got = lake.read("macro_d", since="2020-01-01", columns=["date", "value"]).orderBy("date").collect()
    assert [(str(r["date"]), r["value"]) for r in got] == [("2020-01-02", 9.0), ("2020-01-03", 3.0)]
    assert lake.read("macro_d").count() == 3
    plan = lake.read("macro_d", since="2020-01-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan
    run = lake.start_run("test")
    lake.record_rows(run, 2)
    lake.record_rows(run, 3)
    lake.finish_run(run)
    report = lake.runs().first()
    assert report["rows_added"] == 5 and report["finished_at"] >= report["started_at"]
    counts = {r["table"]: r["n"] for r in lake.row_counts().collect()}
    assert counts["macro_d"] == 3 and counts["news"] == 0
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert lake.cached("panel", "abc", build).count() == lake.cached("panel", "abc", build).count() == 3 and len(built) == 1


def test_extraction_round_trip(spark):
    pending = spark.createDataFrame([("n1", "gold up"), ("n2", "noise")], "id string, body string")

    def backend(body):
        return 'Sure ```json {"gold_impact": 3, "confidence": "0.4", "novel": true}```' if "gold" in body else None

    got = news.coerce_features(news.extract(pending, backend), "v9").collect()
    assert len(got) == 1 and (got[0]["gold_impact"], got[0]["confidence"], got[0]["horizon_minutes"], got[0]["novel"],
                              got[0]["event_type"]) == (1.0, 0.4, 60, True, "other")


def test_settlement_and_storage(spark, tmp_path):
    day = lambda s: dt.date.fromisoformat(s)
    prices = spark.createDataFrame([(day("2024-01-05"), "GC=F", 110.0), (day("2024-02-01"), "GC=F", 120.0)],
                                   "date date, symbol string, close double")
    p = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 16), 3, 100.0, 0.0), ("b", dt.datetime(2024, 1, 2, 16), 5, 100.0, 0.2),
                               ("c", dt.datetime(2024, 1, 30, 16), 60, 100.0, 0.0), ("d", dt.datetime(2024, 1, 1, 16), 3, 0.0, 0.0)],
                              "id string, ts timestamp, horizon_d int, ref_price double, q50 double")
    done = spark.createDataFrame([], "prediction_id string")
    got = {r["prediction_id"]: r for r in settle.settle(p, done, prices, "2024-02-10").collect()}
    assert set(got) == {"a", "b"} and got["a"]["realised_price"] == 110.0 and got["b"]["realised_price"] == 120.0
    assert got["a"]["settled_at"] == dt.datetime(2024, 1, 4, 16)
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.upsert("outcomes", settle.settle(p, done, prices, "2024-02-10"))
    assert settle.settle(p, lake.read("outcomes"), prices, "2024-02-10").count() == 0


def test_dossier_text(spark):
    row = spark.createDataFrame([(dt.date(2024, 1, 2), 2000.0, None, 100.0, 15.0, -1.0, 0.5)],
                                "date date, gold_close double, tips_10y double, dxy_close double, vix_close double, "
                                "cot_mm_net_z double, gld_flow_5d_z double")
    heads = spark.createDataFrame([(i, f"title {i}", 0.5, 0.9, "cpi") for i in range(1, 10)],
                                  "rank int, title string, gold_impact double, confidence double, event_type string")
    past = spark.createDataFrame([(dt.date(2020, 1, i), 0.9 - i / 10, 0.01) for i in range(1, 8)],
                                 "date date, similarity double, target_logret double")
    skill = spark.createDataFrame([(4, 0.5, 0.01)], "n long, hit_rate double, mean_pinball_q50 double")
    out = dossier.dossier_text(dossier.build_dossier(row, heads, past, skill)).first()["text"]
    assert out.count("impact=+0.50") == 8 and out.count("sim=") == 5
    assert "2020-01-01 sim=0.80" in out and "TIPS_10Y: None" in out


def test_white_space_of_any_kind_is_stripped(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.text import strip

    df = spark.createDataFrame([("\n  a b\t　\r\n",), ("\x1f ",), (None,)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "", None]


def test_newest_version_counts_numbers(spark):
    from tidemark.plans.news import latest_version

    rows = [("a", "v9", 1.0), ("a", "v10", 2.0), ("b", "v1", 3.0)]
    df = spark.createDataFrame(rows, "news_id string, model_version string, gold_impact double")
    assert {r.news_id: r.gold_impact for r in latest_version(df).collect()} == {"a": 2.0, "b": 3.0}
    timed = spark.createDataFrame([("a", "v10", "2024-01-01", 1.0), ("a", "v9", "2024-01-02", 2.0)],
                                  "news_id string, model_version string, extracted_at string, gold_impact double")
    assert latest_version(timed).first().gold_impact == 2.0


def test_each_query_vector_is_answered(spark):
    from tidemark.operators.similarity import retrieve

    index = spark.createDataFrame([("2024-01-01", [1.0, 0.0]), ("2024-01-02", [0.0, 1.0]), ("2024-01-03", [0.6, 0.8])],
                                  "date string, vector array<double>")
    query = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "q string, vector array<double>")
    got = [(r.q, r.date) for r in retrieve(index, query, 2, keys=("q",)).collect()]
    assert got == [("x", "2024-01-01"), ("x", "2024-01-03"), ("y", "2024-01-02"), ("y", "2024-01-03")]


def test_repeated_price_days_do_not_run_backwards(spark):
    from tidemark.operators.align import first_on_or_after

    prices = spark.sql("SELECT 's' AS symbol, DATE'2024-01-02' AS date, 1D AS close UNION ALL "
                       "SELECT 's', DATE'2024-01-05', 2D UNION ALL SELECT 's', DATE'2024-01-05', 3D")
    rows = spark.sql("SELECT 's' AS symbol, explode(sequence(DATE'2024-01-01', DATE'2024-01-06')) AS day")
    got = {str(r.day): r.close for r in first_on_or_after(rows, prices, "day").collect()}
    assert [got[f"2024-01-0{i}"] for i in range(1, 7)] == [1.0, 1.0, 3.0, 3.0, 3.0, None]


def test_missing_factors_stay_out_of_the_levels():
    import numpy as np

    from tidemark.operators.scans import regime_scan

    x = np.full((80, 6), np.nan)
    x[::2] = np.linspace(0, 1, 40)[:, None]
    levels = regime_scan().prepare(x, np.arange(1, 81))
    assert np.isclose(levels[79, 6], np.quantile(np.linspace(0, 1, 40), 0.65)) and levels[56, 6] == 0.65
    assert levels[1, 0] == 0.5
