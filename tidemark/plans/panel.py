"""The daily feature panel: one row per calendar date of the target symbol, about 75 columns.

The panel itself is small (one row per day); the work is in aggregating its sources. Features of one
symbol are computed in long form, partitioned by symbol, and turned wide at the end. Every window here
runs over rows with one date each, so a partition never exceeds the number of calendar days.
The schema is fixed: a symbol or series that the data lacks gives null columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import SQRT_YEAR, clip, d, ratio, safe_log
from tidemark.operators.align import calendar_align
from tidemark.operators.blocks import spread
from tidemark.operators.robust import robust_z, rolling_mean, rolling_median
from tidemark.session import write_through

# Symbol -> column prefix.
ASSETS = {"DX-Y.NYB": "dxy", "^VIX": "vix", "^GSPC": "spx", "SLV": "slv", "CL=F": "wti", "HG=F": "copper",
          "BTC-USD": "btc", "GDX": "gdx"}
RATIOS = {"gold_silver_ratio": "slv", "gold_oil_ratio": "wti", "gold_copper_ratio": "copper"}
VOLATILITY = {"DX-Y.NYB": "dxy", "^VIX": "vix"}
MACRO = ["DFII10", "T10YIE", "DGS10", "DGS2", "FEDFUNDS", "VIXCLS"]
LABELS = (5, 20, 60)


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def returns_and_labels(close: DataFrame, lags: tuple[int, ...] = (1, 5, 20), horizons: tuple[int, ...] = LABELS
                       ) -> DataFrame:
    """Log returns by row lag and forward labels per symbol."""
    w = by_symbol()
    out = close.withColumn("_l", safe_log(F.col("close")))
    out = out.withColumns({f"logret_{k}d": F.col("_l") - F.lag("_l", k).over(w) for k in lags})
    out = out.withColumns({f"target_logret_{h}d": F.lead("_l", h).over(w) - F.col("_l") for h in horizons})
    return out.drop("_l")


def yang_zhang(bars: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Annualised open-high-low-close volatility from raw second moments, per symbol."""
    w = by_symbol()
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    on = F.log(o / F.lag("close").over(w))
    oc = F.log(c / o)
    out = bars.withColumns({"_on": on * on, "_oc": oc * oc,
                            "_rs": F.log(h / c) * F.log(h / o) + F.log(l / c) * F.log(l / o)})
    for n in windows:
        frame, need = w.rowsBetween(-(n - 1), 0), max(2, n // 4)
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        var = (rolling_mean(F.col("_on"), frame, need) + k * rolling_mean(F.col("_oc"), frame, need)
               + (1 - k) * rolling_mean(F.col("_rs"), frame, need))
        out = out.withColumn(f"yz_{n}", F.when(var.isNotNull(), F.sqrt(F.greatest(var, d(0))) * SQRT_YEAR))
    return out.drop("_on", "_oc", "_rs")


def _wide(long: DataFrame, key: str, names: dict[str, str], features: dict[str, str]) -> DataFrame:
    """Conditional aggregates instead of a pivot: the values are known, so no extra pass."""
    return long.groupBy("date").agg(*[
        F.max(F.when(F.col(key) == k, F.col(f))).alias(pattern.format(name))
        for k, name in names.items() for f, pattern in features.items()])


def calendar_of(prices: DataFrame, target: str, calendar: str) -> DataFrame:
    dates = prices.where(F.col("close").isNotNull())
    if calendar == "target":
        dates = dates.where(F.col("symbol") == target)
    return dates.select("date").distinct()


def price_block(prices: DataFrame, calendar: DataFrame, target: str, horizons: tuple[int, ...]) -> DataFrame:
    """Closes on the calendar, returns, rolling z, ratios and labels."""
    symbols = [target, *ASSETS]
    grid = calendar.select("date", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"))
    closes = grid.join(prices.select("date", "symbol", "close"), ["date", "symbol"], "left")
    rows = returns_and_labels(spread(closes, "symbol"), horizons=horizons)
    rows = robust_z(rows, {"close": "z"}, by_symbol(), 252)
    names = {target: "gold", **ASSETS}
    features = {"close": "{}_close", **{f"logret_{k}d": f"{{}}_logret_{k}d" for k in (1, 5, 20)}}
    targets = {f"target_logret_{h}d": f"target_logret_{h}d" for h in horizons}
    wide = rows.groupBy("date").agg(
        *[F.max(F.when(F.col("symbol") == s, F.col(f))).alias(p.format(n))
          for s, n in names.items() for f, p in features.items()],
        *[F.max(F.when(F.col("symbol") == s, F.col("z"))).alias(f"{n}_z") for s, n in ASSETS.items()],
        *[F.max(F.when(F.col("symbol") == target, F.col(t))).alias(t) for t in targets])
    return wide.withColumns({name: ratio(F.col("gold_close"), F.col(f"{other}_close"))
                             for name, other in RATIOS.items()})


def volatility_block(prices: DataFrame, calendar: DataFrame, target: str, align: str) -> DataFrame:
    names = {target: "gold", **VOLATILITY}
    yz = yang_zhang(prices.where(F.col("symbol").isin(*names)))
    wide = _wide(yz, "symbol", names, {"yz_20": "{}_yz_20", "yz_5": "{}_yz_5"})
    cols = [f"{n}_yz_{k}" for n in names.values() for k in (20, 5)]
    out = calendar_align(calendar, wide, cols, 2, mode=align)
    return out.withColumns({f"{n}_vol_regime": clip(ratio(F.col(f"{n}_yz_5"), F.col(f"{n}_yz_20")), 0, 5)
                            for n in names.values()})


def macro_block(macro: DataFrame, calendar: DataFrame, align: str) -> DataFrame:
    wide = _wide(macro.where(F.col("series_id").isin(*MACRO)), "series_id", {s: s for s in MACRO}, {"value": "{}"})
    m = calendar_align(calendar, wide, MACRO, 5, mode=align)
    w = Window.orderBy("date")
    m = m.select(
        "date", "VIXCLS", F.col("DFII10").alias("tips_10y"),
        ((F.col("DFII10") - F.lag("DFII10").over(w)) * 100.0).alias("tips_d1_bp"),
        F.col("T10YIE").alias("breakeven_10y"), (F.col("DGS10") - F.col("T10YIE")).alias("real_yield_proxy"),
        (F.col("DGS10") - F.col("DGS2")).alias("yield_curve_2_10"), F.col("FEDFUNDS").alias("fedfunds"))
    return robust_z(m, {"tips_10y": "tips_z"}, w, 252)


def positioning(cot: DataFrame, contract: str = "GOLD_COMEX") -> DataFrame:
    """Net managed-money position and its rolling z on the weekly report rows."""
    rows = cot.where(F.col("contract") == contract).select(
        F.col("report_date").alias("date"), (F.col("mm_long") - F.col("mm_short")).alias("cot_mm_net"), "open_interest")
    out = robust_z(rows, {"cot_mm_net": "cot_mm_net_z", "open_interest": "cot_oi_z"}, Window.orderBy("date"), 52)
    return out.drop("open_interest")


def positioning_block(cot: DataFrame, calendar: DataFrame, align: str, publish_lag_days: int) -> DataFrame:
    rows = positioning(cot)
    if publish_lag_days:
        rows = rows.withColumn("date", F.date_add("date", publish_lag_days))
    return calendar_align(calendar, rows, ["cot_mm_net", "cot_mm_net_z", "cot_oi_z"], 7, mode=align)


def flow_block(flows: DataFrame, calendar: DataFrame, align: str, ticker: str = "GLD") -> DataFrame:
    rows = flows.where(F.col("ticker") == ticker).select("date", "holdings_tonnes", "flow_usd")
    out = calendar_align(calendar, rows, ["holdings_tonnes", "flow_usd"], 2, mode=align)
    w = Window.orderBy("date")
    flow, w5, w20 = F.col("flow_usd"), w.rowsBetween(-4, 0), w.rowsBetween(-19, 0)
    out = out.withColumns({
        "_flow_5d": F.when(F.count(flow).over(w5) >= 2, F.sum(flow).over(w5)),
        "_typical": rolling_median(F.abs(flow), w20, 5),
    })
    out = robust_z(out, {"_flow_5d": "gld_flow_5d_z"}, w, 252)
    return out.select("date", F.col("holdings_tonnes").alias("gld_holdings_tonnes"), "gld_flow_5d_z",
                      ratio(F.abs(flow), F.col("_typical")).alias("gld_flow_intensity"))


def news_block(signal: DataFrame, calendar: DataFrame) -> DataFrame:
    """News signal on the calendar; days without news count as zero."""
    j = calendar.join(signal, "date", "left")
    return j.select("date", *[F.coalesce(F.col(c).cast("double"), d(0)).alias(n) for c, n in
                              (("impact_wmean", "news_impact"), ("intensity", "news_intensity"),
                               ("dispersion", "news_dispersion"))])


def build_panel(prices: DataFrame, macro: DataFrame, cot: DataFrame, flows: DataFrame, news_signal: DataFrame,
                target: str = "GC=F", start: str | None = "2010-01-01", calendar: str = "target",
                align: str = "asof", publish_lag_days: int = 0, horizons: tuple[int, ...] = LABELS) -> DataFrame:
    """All blocks on one date row.

    calendar: 'target' uses the target's trading days, 'union' every date in the price table.
    align: 'asof' moves off-calendar observations to the next calendar day, 'exact' drops them.

    Prices and calendar, which every block reads, are written to the shared folder once instead of being aggregated
    again for each.
    """
    since: list[Column] = [F.lit(start).cast("date")] if start else []

    def cut(df: DataFrame, at: str = "date") -> DataFrame:
        return df.where(F.col(at) >= since[0]) if since else df

    prices = write_through(cut(prices).select("date", "symbol", "open", "high", "low", "close"), "panel-prices")
    dates = write_through(calendar_of(prices, target, calendar), "panel-calendar")
    blocks = [
        price_block(prices, dates, target, horizons),
        volatility_block(prices, dates, target, align),
        macro_block(cut(macro), dates, align),
        positioning_block(cut(cot, "report_date"), dates, align, publish_lag_days),
        flow_block(cut(flows), dates, align),
        news_block(cut(news_signal), dates),
    ]
    panel = reduce(lambda a, b: a.join(b, "date", "left"), blocks)
    # Without any price row of the volatility index its close comes from the macro series.
    absent = F.count("vix_close").over(Window.partitionBy(F.lit(0))) == 0
    panel = panel.withColumn("vix_close", F.when(absent, F.col("VIXCLS")).otherwise(F.col("vix_close")))
    return panel.drop("VIXCLS")


def feature_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in ("date", "gold_close") and not c.startswith("target_")]


def select_features(panel: DataFrame, first: list[str], n: int) -> list[str]:
    """Feature names: those in `first` that exist, then the best covered, up to n.

    Only one number per column reaches the driver.
    """
    from tidemark.operators.robust import coverage

    names = feature_columns(panel)
    share = {r["feature"]: r["coverage"] for r in coverage(panel, names).collect()}
    forced = [c for c in first if c in share]
    rest = sorted((c for c in names if c not in forced), key=lambda c: (-share[c], c))
    return (forced + rest)[:max(n, len(forced))]


def training_rows(panel: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with a label; null features become zero."""
    return panel.where(F.col(label).isNotNull()).fillna(0.0, subset=features)


def latest_panel_row(panel: DataFrame, asof: str) -> DataFrame:
    """The newest row dated on or before `asof`."""
    cols = [c for c in panel.columns if c != "date"]
    return (panel.where(F.col("date") <= F.lit(asof).cast("date")).groupBy()
            .agg(F.max("date").alias("date"), F.max_by(F.struct(*cols), "date").alias("_r"))
            .where(F.col("date").isNotNull()).select("date", "_r.*"))
