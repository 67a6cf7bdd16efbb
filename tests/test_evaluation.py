"""Splits, metrics, calibration, similarity and fits against numpy on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import calibrate, drift, metrics, robust, similarity
from tidemark.plans import training
from tidemark.plans.settle import promote


def series(spark, values, **cols):
    pdf = pd.DataFrame({"i": np.arange(len(values)), "r": values, **cols})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def numbered(spark):
    pdf = pd.concat([pd.DataFrame({"symbol": s, "date": pd.date_range("2010-01-01", periods=n).date, "y": 0.01})
                     for s, n in (("A", 700), ("B", 300))])
    return B.number_days(spark.createDataFrame(pdf), "y", ["symbol"])


WALK = B.Walk(train=252, test=21, embargo=5, horizon=20)


def test_folds_keep_their_distance(numbered):
    test = B.test_rows(numbered, WALK).groupBy("symbol", "fold").agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n")).toPandas()
    train = B.train_rows(numbered, WALK).groupBy("symbol", "fold").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n_train")).toPandas()
    j = test.merge(train, on=["symbol", "fold"], how="outer")
    assert not j.isna().any().any()
    assert (j["n"] == 21).all() and (j["hi"] - j["lo"] == 20).all()
    assert (j["lo"] - j["last"] == 5 + 20 + 1).all()
    assert (j["first"] == 0).all() and (j["n_train"] == j["last"] + 1).all()
    a = j[j["symbol"] == "A"].sort_values("fold")
    assert (np.diff(a["lo"]) == 21).all()
    assert len(a) == (700 - 252) // 21
    bounds = B.folds(numbered.groupBy("symbol").agg(F.max("n").alias("n")), WALK, ["symbol"]).toPandas()
    k = bounds.merge(j, on=["symbol", "fold"])
    assert len(k) == len(j) and (k["train_end"] == k["n_train"]).all() and (k["test_start"] == k["lo"]).all()


def test_folds_without_training_rows_are_skipped(numbered):
    walk = B.Walk(train=10, test=21, embargo=5, horizon=20)
    rows = B.test_rows(numbered, walk).groupBy("symbol", "fold").agg(F.min("i").alias("lo")).toPandas()
    assert rows["fold"].min() == 0 and (rows.loc[rows["fold"] == 0, "lo"] == 31).all()


def test_sharpe_closed_form(spark):
    r = np.random.default_rng(0).normal(0.001, 0.01, 5000)
    got = series(spark, r).agg(metrics.sharpe(F.col("r")).alias("s")).first()["s"]
    assert got == pytest.approx(r.mean() / r.std() * 252 ** 0.5) and 1.0 < got < 2.2
    assert series(spark, np.zeros(50)).agg(metrics.sharpe(F.col("r")).alias("s")).first()["s"] == 0


def numpy_newey_west(r, lag):
    e = r - r.mean()
    var = (e * e).mean() + sum(2 * (1 - k / (lag + 1)) * (e[k:] * e[:-k]).sum() / len(r) for k in range(1, lag + 1))
    return r.mean() / np.sqrt(var) * 252 ** 0.5


def test_newey_west(spark):
    rng = np.random.default_rng(1)
    iid = rng.normal(0.001, 0.01, 2000)
    overlap = np.convolve(rng.normal(0.0005, 0.01, 2000), np.ones(20), "valid")
    for r in (iid, overlap):
        got = metrics.newey_west_sharpe(series(spark, r), "r", "i", lag=20).first()["sharpe_nw"]
        assert got == pytest.approx(numpy_newey_west(r, 20), rel=1e-9)
    naive = iid.mean() / iid.std() * 252 ** 0.5
    assert numpy_newey_west(iid, 20) == pytest.approx(naive, rel=0.2)
    assert numpy_newey_west(overlap, 20) < 0.6 * overlap.mean() / overlap.std() * 252 ** 0.5


def test_bootstrap_interval(spark):
    r = np.random.default_rng(2).normal(0.001, 0.01, 500)
    df = series(spark, r)
    a = metrics.bootstrap_sharpe(df, "r", "i", n_boot=200).first()
    b = metrics.bootstrap_sharpe(df.repartition(7), "r", "i", n_boot=200).first()
    assert a == b and a["sharpe_lo"] <= a["sharpe_med"] <= a["sharpe_hi"]
    short = metrics.bootstrap_sharpe(series(spark, r[:10]), "r", "i").first()
    assert short["sharpe_lo"] == short["sharpe_hi"] == pytest.approx(r[:10].mean() / r[:10].std() * 252 ** 0.5)


def test_pinball_coverage_hit(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.5), (2.0, 3.0)], "y double, q double")
    row = df.agg(metrics.mean_pinball(F.col("y"), F.col("q"), 0.9).alias("p"),
                 metrics.coverage(F.col("y"), F.col("q") - 1, F.col("q") + 1).alias("c"),
                 metrics.hit_rate(F.col("y"), F.col("q")).alias("h")).first()
    assert row["p"] == pytest.approx((0.9 + 0.15 + 0.1) / 3)
    assert row["c"] == pytest.approx(2 / 3) and row["h"] == pytest.approx(1 / 3)


def test_trades_charge_entry_and_change(spark):
    rows = spark.createDataFrame([(0, i, p, 0.02) for i, p in enumerate([0.5, 0.5, -0.5, 0.01])],
                                 "fold int, i int, p double, y double").withColumn("symbol", F.lit("A"))
    got = B.trades(rows, 0.1, ["symbol"], "y", "p", cost_bps=10).orderBy("i").toPandas()
    assert got["pos"].tolist() == [1, 1, -1, 0]
    np.testing.assert_allclose(got["ret"], [0.02 - 0.001, 0.02, -0.02 - 0.002, -0.001])


def test_per_fold_fitting(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 400)
    pdf = pd.DataFrame({"symbol": "A", "date": pd.date_range("2015-01-01", periods=400).date, "x": x, "y": 2 * x})

    def least_squares(x_tr, y_tr, x_all):
        return x_all @ np.linalg.lstsq(x_tr, y_tr, rcond=None)[0]

    walk = B.Walk(train=200, test=50, embargo=5, horizon=10)
    out = B.run(spark.createDataFrame(pdf), "y", walk, ["symbol"], B.per_fold(least_squares, ["x"], "y", ["symbol"]))
    got = out.toPandas()
    assert len(got) == 200
    np.testing.assert_allclose(got["pred"], got["y"], rtol=1e-9)


def test_scaler_and_winsor(spark):
    x = np.random.default_rng(3).standard_t(3, 999)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": 1.0}))
    fit = {r["feature"]: r for r in robust.fit_scaler(df, ["x", "c"]).collect()}
    med = np.median(x)
    assert fit["x"]["med"] == pytest.approx(med)
    assert fit["x"]["mad"] == pytest.approx(1.4826 * np.median(np.abs(x - med)))
    assert fit["c"]["mad"] == 1
    w = {r["feature"]: r for r in robust.fit_winsor(df, ["x", "c"]).collect()}
    np.testing.assert_allclose([w["x"]["lo"], w["x"]["hi"]], np.quantile(x, [0.005, 0.995]))
    assert w["c"]["hi"] == pytest.approx(1 + 1e-6)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_by_group_are_exact(spark, accuracy):
    rng = np.random.default_rng(9)
    sizes = {"hot": 9000, "few": 7, "two": 2, "one": 1, None: 40}
    parts = []
    for key, n in sizes.items():
        x = np.where(rng.random(n) < 0.5, 1.5, rng.standard_cauchy(n) * 10)  # half of all rows share a value
        parts.append(pd.DataFrame({"k": [key] * n, "x": x, "y": np.round(x), "_n": 1}))
    pdf = pd.concat([*parts, pd.DataFrame({"k": ["none"] * 3, "x": [np.nan] * 3, "y": [np.nan] * 3, "_n": 1})])
    df = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in "xy"})
    levels = [0.0, 0.005, 0.3, 0.5, 0.77, 0.995, 1.0]
    got = {r["k"]: r for r in robust.quantiles(df, ["x", "y"], levels, ["k"], accuracy).collect()}
    assert got.keys() == sizes.keys() | {"none"} and got["none"]["x"] is None
    for key, part in zip(sizes, parts):
        for c in "xy":
            np.testing.assert_allclose(got[key][c], np.quantile(part[c], levels))
    whole = robust.quantiles(df, ["y"], levels, accuracy=accuracy).collect()
    np.testing.assert_allclose(whole[0]["y"], np.quantile(pdf["y"].dropna(), levels))
    assert robust.quantiles(df.limit(0), ["x"], [0.5]).collect()[0]["x"] is None
    assert robust.quantiles(df.limit(0), ["x"], [0.5], ["k"]).collect() == []


def test_ks_distance(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 500), np.round(rng.normal(0.4, 1, 200), 1)
    base, recent = spark.createDataFrame(pd.DataFrame({"x": a})), spark.createDataFrame(pd.DataFrame({"x": b}))
    got = drift.ks_drift(base, recent, ["x"], buckets=8).first()
    grid = np.sort(np.concatenate([a, b]))
    want = np.abs(np.searchsorted(np.sort(a), grid, "right") / 500 - np.searchsorted(np.sort(b), grid, "right") / 200).max()
    assert got["d_stat"] == pytest.approx(want) and got["drifted"]
    assert drift.ks_drift(base, recent.limit(10), ["x"]).count() == 0


def test_permutation_importance_ranks_the_driver(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(0, 1, 500), rng.normal(0, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "x": x, "z": z, "y": x}))
    got = drift.permutation_importance(df, ["x", "z"], "y", lambda c: c["x"] + 0.01 * c["z"], "id").collect()
    assert [r["feature"] for r in got] == ["x", "z"] and got[0]["delta_pinball"] > 0.3 > got[1]["delta_pinball"]


def test_conformal_scale_reaches_coverage(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(0, 0.03, 2000)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "mu": 0.0, "s": 0.01}))
    scale = calibrate.conformal_scale(df, "y", "mu", "s").first()[0]
    assert scale == pytest.approx(np.quantile(np.abs(y) / (0.01 + 1e-8), 0.8) / 1.2816)
    q = calibrate.band(F.col("mu"), F.col("s"), scale)
    inside = df.agg(metrics.coverage(F.col("y"), q["q10"], q["q90"])).first()[0]
    assert 0.79 < inside < 0.81
    assert calibrate.conformal_scale(df.limit(5), "y", "mu", "s", previous=1.7).first()[0] == 1.7


def test_band_and_monotone_repair(spark):
    row = spark.range(1).select(
        calibrate.monotone(F.array(F.lit(0.1), F.lit(0.0), F.lit(0.3), F.lit(0.2), F.lit(0.5))).alias("m"),
        calibrate.price_band(F.lit(100.0), F.lit(0.01), F.array(F.lit(0.02), F.lit(-0.02))).alias("p")).first()
    assert row["m"] == [0.1, 0.1, 0.3, 0.3, 0.5]
    np.testing.assert_allclose(row["p"], 100 * np.exp([-0.01, 0.03]))


def test_top_k_in_cells_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    m, q = rng.normal(0, 1, (700, 8)), rng.normal(0, 1, (30, 8))
    memory = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    got = similarity.top_k_similar(queries, memory, 5, cell_rows=100, cell_queries=7).toPandas()
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    sims = unit(q) @ unit(m).T
    for i in range(30):
        mine = got[got["query_id"] == i].sort_values("rank")
        assert mine["vec_id"].tolist() == np.argsort(-sims[i], kind="stable")[:5].tolist()


def test_quantile_fit_finds_the_lines(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(-1, 1, 4000)
    y = 0.5 * x + rng.normal(0, 0.1, 4000)
    fit = training.fit_quantiles(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), ["x"], "y", (0.1, 0.5, 0.9))
    for tau, z in ((0.1, -1.2816), (0.5, 0.0), (0.9, 1.2816)):
        slope, level = fit[tau]
        assert slope == pytest.approx(0.5, abs=0.03) and level == pytest.approx(z * 0.1, abs=0.02)


def test_quantile_fit_reaches_the_least_loss(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(0, 1, (3000, 3)) * [1.0, 20.0, 0.01]
    y = x @ [0.3, -0.02, 5.0] + rng.standard_t(2, 3000) * (0.1 + 0.05 * np.abs(x[:, 0]))  # heavy tails, uneven spread
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, same=x[:, 0])
    pdf.loc[0, "y"] = None
    fit = training.fit_quantiles(spark.createDataFrame(pdf), ["a", "b", "c", "same"], "y", ridge=0.0)
    full = np.column_stack([x, x[:, 0], np.ones(3000)])[1:]
    for tau, w in fit.items():
        def loss(v):
            e = y[1:] - full @ v
            return np.maximum(tau * e, (tau - 1) * e).mean()
        below = y[1:] < full @ w
        assert abs(below.mean() - tau) < 0.01
        for i in range(5):
            assert abs((full[:, i] * (below - tau)).sum()) < 0.02 * np.abs(full[:, i]).sum()
        scale = 1 / np.abs(full).mean(axis=0)
        assert all(loss(w) < loss(w + 0.1 * rng.normal(0, 1, 5) * scale) * (1 + 1e-3) for _ in range(50))
    none = training.fit_quantiles(spark.createDataFrame([], "a double, y double"), ["a"], "y", (0.5,), {"a": 2.0})
    assert none[0.5].tolist() == [2.0, 0.0]


def test_replay_sample_of_each_key(spark):
    rows = [("hot", i, i % 7) for i in range(4000)] + [("few", i, i) for i in range(5)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = training.replay_sample(df, ["at"], ["k"], 300, 1000, draw=F.col("at")).collect()
    hot = sorted(r["at"] for r in got if r["k"] == "hot")
    assert len(hot) == len(set(hot)) == 300 and hot[0] >= 3000 and 3400 < np.mean(hot) < 3600
    assert sorted(r["at"] for r in got if r["k"] == "few") == list(range(5)) and len(got) == 306
    again = training.replay_sample(df.repartition(7), ["at"], ["k"], 300, 1000, draw=F.col("at")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert training.newest(df, ["at", "k"], 3).count() == 3


def test_training_beats_nothing(spark):
    rng = np.random.default_rng(12)
    n = 600
    x, z = rng.normal(0, 1, n), rng.normal(0, 1, n)
    pdf = pd.DataFrame({"date": pd.date_range("2012-01-01", periods=n).date, "gold_close": 100.0, "vix_logret_1d": x,
                        "z": z, "target": 0.02 * x + 0.01 * rng.normal(0, 1, n)})
    df = spark.createDataFrame(pdf)
    model = training.train(df, ["vix_logret_1d", "z"], "target", steps=25, trees=3)
    got = model.score(df, ("date", "target")).toPandas()
    assert np.corrcoef(got["mu"], got["target"])[0, 1] > 0.8
    inside = ((got["target"] >= got["q10"]) & (got["target"] <= got["q90"])).mean()
    assert 0.7 < inside < 0.9
    assert (np.diff(got[["q10", "q25", "q50", "q75", "q90"]].to_numpy(), axis=1) >= 0).all()
    parts = training.diagnostics(model, df, "target", repeats=2)
    assert parts["importance"].first()["feature"] == "vix_logret_1d" and parts["drift"].count() == 2


def test_promotion_rule(spark):
    cols = ("horizon string, path string, has_metrics boolean, sharpe_nonoverlap double, sharpe_nw double, "
            "sharpe_med double, sharpe_lo double")
    new = spark.createDataFrame([
        ("5d", "a", True, None, 0.5, 0.9, -0.1), ("20d", "b", True, 0.5, 0.1, 0.1, 0.2), ("60d", "c", False, None, None, None, None),
        ("90d", "d", False, None, None, None, None), ("1d", "e", True, 0.5, 0.1, 0.1, -0.3)], cols)
    old = spark.createDataFrame([("20d", "x", True, 0.46, None, None, 0.1), ("60d", "y", True, 0.1, None, None, 0.1)], cols)
    got = {r["horizon"]: r["promoted"] for r in promote(new, old).collect()}
    assert got == {"5d": True, "20d": False, "60d": False, "90d": True, "1d": False}
