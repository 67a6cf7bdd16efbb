"""Block-wise results equal plain windows, whatever the block size and however skewed the keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import align, bars, calibrate, causal, ranges, scans, ticks
from tidemark.operators.blocks import Order, index_rows, running, ticks_order


@pytest.fixture(scope="module")
def skewed(spark):
    """One symbol holds nine tenths of the rows, in bursts with equal timestamps."""
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "event_id": np.arange(n), "symbol": np.where(rng.random(n) < 0.9, "HOT", "COLD"),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 4000, n)) * 7, unit="s"),
        "mid": np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2).clip(5), "spread": 0.1,
        "volume": rng.integers(0, 50, n).astype(float)})
    return spark.createDataFrame(pdf).cache()


def collected(df, cols, key="event_id"):
    pdf = df.select(key, *cols).toPandas().sort_values(key)
    return pdf.reset_index(drop=True)


def test_row_numbers(spark, skewed):
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    plain = collected(skewed.withColumn("rn", F.row_number().over(w)), ["rn"])
    ours = collected(index_rows(skewed, ticks_order(grain_seconds=300)), ["rn"])
    assert (plain["rn"] == ours["rn"]).all()


def test_running_totals_and_last(skewed):
    order = ticks_order(grain_seconds=120)
    known = F.when(F.col("volume") > 40, F.col("mid"))
    ours = collected(running(skewed, order, {"s": ("sum", F.col("volume")), "m": ("max", F.col("mid")),
                                             "l": ("last", known)}), ["s", "m", "l"])
    w = Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = collected(skewed.withColumns({
        "s": F.sum("volume").over(w), "m": F.max("mid").over(w), "l": F.last(known, ignorenulls=True).over(w)}),
        ["s", "m", "l"])
    pd.testing.assert_frame_equal(ours, plain)


def test_indicators_do_not_depend_on_blocks(skewed):
    cols = ["returns_20", "vol_20", "rsi_14", "stoch_d", "obv_norm", "macd", "macd_signal", "frac_diff", "bb_pct"]
    one = collected(ticks.tick_indicators(skewed), cols)
    many = collected(ticks.tick_indicators(skewed, size=256), cols)
    np.testing.assert_allclose(one[cols].to_numpy(), many[cols].to_numpy(), rtol=1e-9, atol=1e-9)


def test_macd_recursion(skewed):
    got = collected(ticks.tick_indicators(skewed, size=256), ["macd", "macd_signal"])
    pdf = skewed.toPandas().sort_values(["ts", "event_id"])
    want = []
    for _, g in pdf.groupby("symbol"):
        fast = slow = sig = None
        for k, r in enumerate(g.itertuples()):
            if k == 0:
                continue
            fast = r.mid if fast is None else fast + 2 / 13 * (r.mid - fast)
            slow = r.mid if slow is None else slow + 2 / 27 * (r.mid - slow)
            sig = fast - slow if sig is None else sig + 0.2 * (fast - slow - sig)
            want.append((r.event_id, (fast - slow) / (r.mid + 1e-8), sig / (r.mid + 1e-8)))
    want = pd.DataFrame(want, columns=["event_id", "macd", "macd_signal"]).sort_values("event_id")
    np.testing.assert_allclose(got[["macd", "macd_signal"]], want[["macd", "macd_signal"]], rtol=1e-9, atol=1e-12)


def test_robust_z_blocks(skewed):
    cols = ["z_price", "price_mean", "price_std"]
    one = collected(ticks.rolling_robust_z(skewed), cols)
    many = collected(ticks.rolling_robust_z(skewed, size=512), cols)
    np.testing.assert_allclose(one[cols], many[cols], rtol=1e-9)


def test_no_lookahead(skewed):
    cols = ["returns_5", "vol_20", "rsi_14", "stoch_k", "macd", "obv_norm", "frac_diff"]
    cut = skewed.where("event_id < 1500")
    part = collected(ticks.tick_indicators(cut, size=512), cols)
    whole = collected(ticks.tick_indicators(skewed, size=512), cols)
    whole = whole[whole["event_id"].isin(part["event_id"])]
    np.testing.assert_allclose(part[cols], whole[cols], rtol=1e-9, atol=1e-12)


def test_asof_join_matches_merge_asof(spark, skewed):
    left = skewed.select("symbol", "ts", "event_id")
    right = skewed.where("volume > 45").groupBy("symbol", "ts").agg(F.max("mid").alias("price"))
    for direction in ("backward", "forward"):
        got = align.asof_join(left, right, ("symbol",), "ts", ["price"], "event_id", direction, grain_seconds=600)
        got = got.select("event_id", "price").toPandas().sort_values("event_id").reset_index(drop=True)
        want = pd.merge_asof(left.toPandas().sort_values("ts"), right.toPandas().sort_values("ts"), on="ts", by="symbol",
                             direction=direction)[["event_id", "price"]].sort_values("event_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want)


def plain_scan(pdf, scan):
    out = []
    for _, g in pdf.groupby("symbol"):
        g = g.sort_values("rn")
        x = g[list(scan.inputs)].to_numpy(dtype=float)
        x = scan.prepare(x, g["rn"].to_numpy()) if scan.prepare else x
        values, _ = scan.run(x, scan.start)
        out.append(pd.DataFrame(values, columns=scan.outputs).assign(event_id=g["event_id"].to_numpy()))
    return pd.concat(out).sort_values("event_id").reset_index(drop=True)


def test_garch_blocks_equal_one_pass(skewed):
    rows = ticks.log_returns(skewed).select("event_id", "symbol", "rn", "log_ret")
    scan = scans.garch_scan()
    got = collected(scans.speculative_scan(rows, scan, ticks_order(), size=300, warmup=200), list(scan.outputs))
    want = plain_scan(rows.toPandas(), scan)
    np.testing.assert_array_equal(got[list(scan.outputs)], want[list(scan.outputs)])


def test_regime_blocks_equal_one_pass(skewed):
    base = index_rows(skewed, ticks_order())
    inputs = {c: (F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(1000)) / 1000.0) for i, c in
              enumerate(scans.REGIME_INPUTS)}
    rows = base.select("event_id", "symbol", "rn", *[c.alias(n) for n, c in inputs.items()])
    scan = scans.regime_scan(window=100)
    got = collected(scans.speculative_scan(rows, scan, ticks_order(), size=300, warmup=200), list(scan.outputs))
    want = plain_scan(rows.toPandas(), scan)
    np.testing.assert_allclose(got[list(scan.outputs)], want[list(scan.outputs)], rtol=1e-12)


def test_scan_that_never_forgets_falls_back(skewed):
    """A plain sum has no memory loss: the check fails and the ordered pass gives the exact result."""
    def run(x, state):
        total = np.cumsum(x[:, 0]) + state[0]
        return total[:, None], (float(total[-1]) if len(total) else state[0],)

    scan = scans.Scan(("volume",), ("total",), (0.0,), run)
    rows = index_rows(skewed, ticks_order()).select("event_id", "symbol", "rn", "volume")
    got = collected(scans.carried_scan(rows, scan, ticks_order(), size=200, warmup=100), ["total"])
    want = plain_scan(rows.toPandas(), scan)
    np.testing.assert_array_equal(got["total"], want["total"])


def test_scan_that_never_forgets_settles_in_few_rounds(spark, monkeypatch):
    """Spans of blocks grow from round to round, so 40 blocks that all follow a wrong guess need no 40 rounds."""
    def run(x, state):
        total = np.cumsum(x[:, 0]) + state[0]
        return total[:, None], (float(total[-1]),)

    scan = scans.Scan(("v",), ("total",), (0.0,), run, lambda x, rn: x, lookback=3)
    pdf = pd.DataFrame({"event_id": np.arange(4500), "symbol": np.where(np.arange(4500) % 9 > 0, "hot", None),
                        "v": np.random.default_rng(8).integers(1, 9, 4500).astype(float)})
    pdf["rn"] = pdf.groupby("symbol", dropna=False).cumcount() + 1
    rounds = []
    write = session.write_through
    monkeypatch.setattr(session, "write_through", lambda df, name: rounds.append(name) or write(df, name))
    got = collected(scans.speculative_scan(spark.createDataFrame(pdf), scan, ticks_order(), size=100, warmup=20), ["total"])
    want = pdf.groupby("symbol", dropna=False)["v"].cumsum()
    np.testing.assert_array_equal(got["total"], want)
    assert 1 < rounds.count("scan") < 6


def test_only_blocks_with_another_state_run_again(spark, monkeypatch):
    """One symbol holds 90 % of the rows; its state is forgotten at each reset, so few blocks follow a wrong guess."""
    def run(x, state):
        out, total = [], state[0]
        for v in x[:, 0].tolist():
            total = 0.0 if v < 0 else total + v
            out.append(total)
        return np.array(out).reshape(-1, 1), (total,)

    scan = scans.Scan(("v",), ("total",), (0.0,), run)
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"event_id": np.arange(6000), "symbol": np.where(np.arange(6000) % 10 > 0, "hot", None),
                        "v": np.where(rng.random(6000) < 0.01, -1.0, rng.integers(0, 9, 6000)).astype(float)})
    pdf["rn"] = pdf.groupby("symbol", dropna=False).cumcount() + 1
    tables = []
    write = session.write_through
    monkeypatch.setattr(session, "write_through", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    got = collected(scans.speculative_scan(spark.createDataFrame(pdf), scan, ticks_order(), size=100, warmup=20), ["total"])
    want = np.empty(len(pdf))
    for _, g in pdf.groupby("symbol", dropna=False):
        want[g.index] = run(g[["v"]].to_numpy(), (0.0,))[0][:, 0]
    np.testing.assert_array_equal(got["total"], want)
    runs = [t.where("_first").count() for name, t in tables if name == "scan"]
    assert runs[0] == 60 and 1 < len(runs) < 20 and runs == sorted(runs, reverse=True) and sum(runs[2:]) < 30


@pytest.mark.parametrize("spread_ids", [1, 1 << 47])
def test_logical_clock_whatever_the_distance_of_ids(spark, spread_ids):
    rng = np.random.default_rng(7)
    at = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 2000, 5000)) + rng.integers(0, 30, 5000), "ms")
    pdf = pd.DataFrame({"event_id": np.arange(5000) * spread_ids, "ts": at})
    got = bars.logical_clock(spark.createDataFrame(pdf)).orderBy("event_id").toPandas()["logical_t"]
    t, want = 0, []
    for ms in at.astype("int64") // 10 ** (6 if at.dtype.str.endswith("[ns]") else 3):
        t = max(t, int(ms) % 2 ** 48) + 1
        want.append(t)
    assert got.tolist() == want


def test_fusion_of_a_burst_is_dealt_evenly(spark):
    n = 4000
    base = spark.range(n).select(F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
                                 F.col("id").cast("double").alias("mid"))
    feed = base.where("event_id % 7 = 0").select("event_id", "ts", F.col("event_id").alias("value"))
    got = align.latest_value_fusion(base, {"f": feed}).orderBy("event_id").collect()
    assert [r.f for r in got] == [r.event_id // 7 * 7 for r in got] or all(r.f == (n - 1) // 7 * 7 for r in got)
    parts = ranges.ranged(base.crossJoin(spark.range(1)).drop("id"), [], ["ts"]).groupBy("_part").count().collect()
    assert max(r["count"] for r in parts) <= 2 * n / len(parts) and len(parts) > 1


def test_row_numbers_of_null_and_hot_keys(spark):
    pdf = pd.DataFrame({"k": ["hot"] * 900 + [None] * 90 + ["x"] * 10, "v": np.random.default_rng(8).permutation(1000) // 3})
    got = ranges.numbered(spark.createDataFrame(pdf), ["k"], ["v"]).toPandas()
    for _, g in got.groupby("k", dropna=False):
        assert sorted(g["place"]) == list(range(len(g))) and set(g["total"]) == {len(g)}
        assert g.sort_values("place")["v"].is_monotonic_increasing
    assert ranges.numbered(spark.createDataFrame([], "k string, v long"), ["k"], ["v"]).count() == 0


def test_residual_window_counts_known_ones_only(spark):
    rng = np.random.default_rng(9)
    n = 900
    pdf = pd.DataFrame({"event_id": np.arange(n), "symbol": "A", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "s"),
                        "rn": np.arange(1, n + 1), "residual": np.where(rng.random(n) < 0.3, rng.normal(0, 1, n), np.nan), "sigma": 2.0})
    df = spark.createDataFrame(pdf).withColumn("residual", F.when(~F.isnan("residual"), F.col("residual")))
    got = calibrate.rolling_residual_quantiles(df, "residual", "sigma", 4, ticks_order(), rows=40, size=50).orderBy("rn").toPandas()
    for i, r in got.iterrows():
        known = pdf["residual"][:i + 1].dropna().to_numpy()[-40:]
        want = np.quantile(known, 0.25) if len(known) >= 16 else calibrate.NORMAL_Z[1]
        assert r["n_residuals"] == len(known) and abs(r[f"resid_{calibrate.BAND[1]}"] - 4 * want) < 1e-9


def test_moments_of_values_far_from_zero(spark):
    pdf = pd.DataFrame({"event_id": np.arange(500), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(500), "s"),
                        "symbol": np.where(np.arange(500) % 5 > 0, "A", "B"), "v": 1e9 + np.random.default_rng(10).normal(0, 1e-2, 500)})
    got = ticks.cumulative_moments(spark.createDataFrame(pdf), "v", ticks_order()).orderBy("event_id").toPandas()
    for symbol, g in pdf.groupby("symbol"):
        want = (g["v"] - 1e9).expanding().std().to_numpy()
        np.testing.assert_allclose(got["cum_sd"][got["symbol"] == symbol], want, rtol=1e-4)


def test_kalman_gain_filter(skewed):
    got = collected(scans.kalman_confidence(skewed.withColumn("obs", F.col("volume") / 50), "obs", ticks_order()),
                    ["confidence"])
    small = collected(scans.kalman_confidence(skewed.withColumn("obs", F.col("volume") / 50), "obs", ticks_order(),
                                              size=700), ["confidence"])
    want = []
    for _, g in skewed.toPandas().sort_values(["ts", "event_id"]).groupby("symbol"):
        x, p = 0.55, 0.1
        for r in g.itertuples():
            k = (p + 0.001) / (p + 0.051)
            x, p = x + k * (r.volume / 50 - x), (1 - k) * (p + 0.001)
            want.append((r.event_id, min(max(x, 0.1), 0.99)))
    want = pd.DataFrame(want, columns=["event_id", "c"]).sort_values("event_id")["c"]
    np.testing.assert_allclose(got["confidence"], want, rtol=1e-9)
    np.testing.assert_allclose(small["confidence"], want, rtol=1e-9)


def test_granger_blocks_equal_direct_evaluation(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.cumsum(rng.normal(0, 1, n))
    y = np.concatenate([[0, 0], np.cumsum(0.8 * np.diff(x)[:-1])]) + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({"cause": "OIL", "t": np.arange(n), "x": x, "y": y})
    order = Order(("cause",), ("t",), F.floor(F.col("t") / 50).cast("long"))
    got = causal.granger_weights(spark.createDataFrame(pdf), order, size=64).orderBy("t").toPandas()
    lag, smooth, want = None, 0.5, []
    for i in range(n):
        a, b = x[max(0, i - 119):i + 1], y[max(0, i - 119):i + 1]
        if len(a) < 18:
            continue
        if lag is None or (i + 1) % 50 == 0:
            lag = causal.best_lag(a, b)
        w = causal.granger_weight(a, b, lag)
        smooth = 0.9 * smooth + 0.1 * w
        want.append((i, w, smooth))
    want = pd.DataFrame(want, columns=["t", "weight", "smoothed"])
    np.testing.assert_allclose(got[["weight", "smoothed"]], want[["weight", "smoothed"]], rtol=1e-8, atol=1e-10)
    assert got["weight"].iloc[-1] > 0.9
