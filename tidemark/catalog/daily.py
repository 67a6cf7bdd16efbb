"""Daily queries: returns, volatility, rolling z, aligned macro/positioning/flow blocks, the whole panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import views
from tidemark.catalog import query, rounded, rounded_sql, with_views
from tidemark.operators import align, robust
from tidemark.plans import news as N
from tidemark.plans import panel as P
from tidemark.session import write_through
from tidemark.sources import history

START = "1995-01-01"


def dated(df, *cols):
    """Dates as text: both engines print them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in (cols or ("date",))})


def rz(out: str, src: str, col: str, name: str, window: int, part: str = "") -> str:
    need = robust.min_periods(window)
    f = f"WINDOW f AS ({part} ORDER BY date ROWS {window - 1} PRECEDING)"
    return f"""
{out}_m AS (SELECT *, CASE WHEN count({col}) OVER f >= {need} THEN median({col}) OVER f END AS med FROM {src} {f}),
{out}_dv AS (SELECT *, abs({col} - med) AS dev FROM {out}_m),
{out} AS (SELECT * EXCLUDE (med, dev), ({col} - med) / nullif(1.4826e0 * (CASE WHEN count(dev) OVER f >= {need}
  THEN median(dev) OVER f END), 0) AS {name} FROM {out}_dv {f})"""


def aligned(out: str, src: str, cols: list[str], limit: int, mode: str) -> str:
    """Calendar alignment of `src` on the CTE `cal`, then limited forward fill."""
    if mode == "exact":
        placed = f"SELECT date, {', '.join(cols)} FROM {src}"
    else:
        picks = ", ".join(f"arg_max({c}, obs) FILTER ({c} IS NOT NULL) AS {c}" for c in cols)
        placed = f"""SELECT day AS date, {picks} FROM (
          SELECT (SELECT min(c.date) FROM cal c WHERE c.date >= s.date) AS day, s.date AS obs, {', '.join(cols)}
          FROM {src} s WHERE s.date >= (SELECT min(date) FROM cal)) WHERE day IS NOT NULL GROUP BY 1"""
    fills = ", ".join(f"last_value({c} IGNORE NULLS) OVER f AS {c}" for c in cols)
    return f"""
{out}_p AS ({placed}),
{out} AS (SELECT cal.date, {fills} FROM cal LEFT JOIN {out}_p p ON p.date = cal.date
          WINDOW f AS (ORDER BY cal.date ROWS {limit} PRECEDING))"""


def yz_sql(windows=(5, 20)) -> str:
    parts = []
    for n in windows:
        need, k = max(2, n // 4), 0.34 / (1.34 + (n + 1) / (n - 1))
        avg = lambda c: (f"(CASE WHEN count({c}) OVER w{n} >= {need} THEN avg({c}) OVER w{n} END)")
        parts.append(f"sqrt(greatest({avg('on2')} + {k!r}e0 * {avg('oc2')} + (1e0 - {k!r}e0) * {avg('rs')}, 0e0) * 252e0)"
                     f" AS yz_{n}, {avg('on2')} + {avg('oc2')} + {avg('rs')} AS chk_{n}")
    wins = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in windows)
    cols = ", ".join(f"CASE WHEN chk_{n} IS NOT NULL THEN yz_{n} END AS yz_{n}" for n in windows)
    return f"""
yz_r AS (SELECT date, symbol, pow(ln(open / lag(close) OVER s), 2) AS on2, pow(ln(close / open), 2) AS oc2,
   ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM prices
   WINDOW s AS (PARTITION BY symbol ORDER BY date)),
yz_s AS (SELECT date, symbol, {', '.join(parts)} FROM yz_r WINDOW {wins}),
yz AS (SELECT date, symbol, {cols} FROM yz_s)"""


PRICES = f"prices AS (SELECT * FROM prices_d WHERE date >= DATE '{START}')"


@query("panel_returns_labels", with_views(["prices_d"], f"""{PRICES},
l AS (SELECT *, ln(close) AS lc FROM prices),
r AS (SELECT CAST(date AS VARCHAR) AS date, symbol,
  lc - lag(lc, 1) OVER w AS logret_1d, lc - lag(lc, 5) OVER w AS logret_5d, lc - lag(lc, 20) OVER w AS logret_20d,
  lead(lc, 5) OVER w - lc AS target_logret_5d, lead(lc, 20) OVER w - lc AS target_logret_20d,
  lead(lc, 60) OVER w - lc AS target_logret_60d FROM l WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT date, symbol, {rounded_sql({c: 6 for c in ("logret_1d", "logret_5d", "logret_20d", "target_logret_5d",
                                                  "target_logret_20d", "target_logret_60d")})} FROM r"""))
def panel_returns_labels(spark, sf_dir):
    out = P.returns_and_labels(views.prices_d(spark, sf_dir).select("date", "symbol", "close"))
    digits = {c: 6 for c in out.columns if "logret" in c}
    return dated(rounded(out.select("date", "symbol", *digits), digits))


@query("panel_robust_z", with_views(["prices_d"], f"""{PRICES},{rz("z", "prices", "close", "close_z", 252,
                                                                  "PARTITION BY symbol")}
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql({"close_z": 6})} FROM z"""))
def panel_robust_z(spark, sf_dir):
    out = robust.robust_z(views.prices_d(spark, sf_dir), {"close": "close_z"}, P.by_symbol(), 252)
    return dated(rounded(out.select("date", "symbol", "close_z"), {"close_z": 6}))


@query("panel_yang_zhang", with_views(["prices_d"], f"""{PRICES},{yz_sql()},
r AS (SELECT *, greatest(0e0, least(5e0, yz_5 / nullif(yz_20, 0))) AS reg FROM yz),
q AS (SELECT *, CASE WHEN yz_5 / nullif(yz_20, 0) IS NOT NULL THEN reg END AS vol_regime FROM r)
SELECT CAST(date AS VARCHAR) AS date, symbol, {rounded_sql({"yz_5": 6, "yz_20": 6, "vol_regime": 6})} FROM q"""))
def panel_yang_zhang(spark, sf_dir):
    from tidemark.functions.numeric import clip, ratio

    out = P.yang_zhang(views.prices_d(spark, sf_dir)).withColumn(
        "vol_regime", clip(ratio(F.col("yz_5"), F.col("yz_20")), 0, 5))
    return dated(rounded(out.select("date", "symbol", "yz_5", "yz_20", "vol_regime"),
                         {"yz_5": 6, "yz_20": 6, "vol_regime": 6}))


def target_calendar(spark, sf_dir):
    return P.calendar_of(views.prices_d(spark, sf_dir), "GC=F", "target")


CAL = "cal AS (SELECT DISTINCT date FROM prices WHERE symbol = 'GC=F')"
CAL_ALL = "cal AS (SELECT DISTINCT date FROM prices)"


def macro_sql(mode: str) -> str:
    wide = ", ".join(f"max(value) FILTER (series_id = '{s}') AS {s}" for s in P.MACRO)
    return f"""
mw AS (SELECT date, {wide} FROM macro_d WHERE date >= DATE '{START}' GROUP BY date),{aligned("ma", "mw", P.MACRO, 5, mode)},
mf AS (SELECT date, DFII10 AS tips_10y, (DFII10 - lag(DFII10) OVER (ORDER BY date)) * 1e2 AS tips_d1_bp,
  T10YIE AS breakeven_10y, DGS10 - T10YIE AS real_yield_proxy, DGS10 - DGS2 AS yield_curve_2_10,
  FEDFUNDS AS fedfunds, VIXCLS FROM ma),{rz("macro", "mf", "tips_10y", "tips_z", 252)}"""


def cot_sql(mode: str) -> str:
    return f"""
cw AS (SELECT report_date AS date, mm_long - mm_short AS cot_mm_net, open_interest FROM cot_disagg
       WHERE report_date >= DATE '{START}'),{rz("cz", "cw", "cot_mm_net", "cot_mm_net_z", 52)},{
       rz("co", "cz", "open_interest", "cot_oi_z", 52)},{
       aligned("cot", "co", ["cot_mm_net", "cot_mm_net_z", "cot_oi_z"], 7, mode)}"""


def flow_sql(mode: str) -> str:
    return f"""
fh AS (SELECT date, holdings_tonnes, (shares_out - lag(shares_out) OVER (ORDER BY date)) * nav AS flow_usd
       FROM etf_holdings),
fw AS (SELECT * FROM fh WHERE date >= DATE '{START}'),{aligned("fa", "fw", ["holdings_tonnes", "flow_usd"], 2, mode)},
ff AS (SELECT *, CASE WHEN count(flow_usd) OVER w5 >= 2 THEN sum(flow_usd) OVER w5 END AS flow_5d,
   CASE WHEN count(flow_usd) OVER w20 >= 5 THEN median(abs(flow_usd)) OVER w20 END AS typical FROM fa
   WINDOW w5 AS (ORDER BY date ROWS 4 PRECEDING), w20 AS (ORDER BY date ROWS 19 PRECEDING)),{
   rz("fz", "ff", "flow_5d", "gld_flow_5d_z", 252)},
flow AS (SELECT date, holdings_tonnes AS gld_holdings_tonnes, gld_flow_5d_z,
   abs(flow_usd) / nullif(typical, 0) AS gld_flow_intensity FROM fz)"""


MACRO_DIGITS = {c: 6 for c in ("tips_10y", "tips_d1_bp", "tips_z", "breakeven_10y", "real_yield_proxy",
                               "yield_curve_2_10", "fedfunds")}
COT_DIGITS = {"cot_mm_net": 2, "cot_mm_net_z": 6, "cot_oi_z": 6}
FLOW_DIGITS = {"gld_holdings_tonnes": 6, "gld_flow_5d_z": 6, "gld_flow_intensity": 6}


@query("panel_macro_align", with_views(["prices_d", "macro_d"], f"""{PRICES}, {CAL},{macro_sql("asof")}
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql(MACRO_DIGITS)} FROM macro"""))
def panel_macro_align(spark, sf_dir):
    out = P.macro_block(views.macro_d(spark, sf_dir), target_calendar(spark, sf_dir), "asof")
    return dated(rounded(out.select("date", *MACRO_DIGITS), MACRO_DIGITS))


@query("panel_macro_exact", with_views(["prices_d", "macro_d"], f"""{PRICES}, {CAL},{macro_sql("exact")}
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql(MACRO_DIGITS)} FROM macro"""))
def panel_macro_exact(spark, sf_dir):
    out = P.macro_block(views.macro_d(spark, sf_dir), target_calendar(spark, sf_dir), "exact")
    return dated(rounded(out.select("date", *MACRO_DIGITS), MACRO_DIGITS))


@query("panel_cot", with_views(["prices_d", "cot_disagg"], f"""{PRICES}, {CAL},{cot_sql("asof")}
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql(COT_DIGITS)} FROM cot"""))
def panel_cot(spark, sf_dir):
    cot = views.cot_disagg(spark, sf_dir).where(F.col("report_date") >= F.lit(START).cast("date"))
    out = P.positioning_block(cot, target_calendar(spark, sf_dir), "asof", 0)
    return dated(rounded(out.select("date", *COT_DIGITS), COT_DIGITS))


def etf_flows(spark, sf_dir):
    return history.fund_flows(views.etf_holdings(spark, sf_dir))


@query("panel_etf_flows", with_views(["prices_d", "etf_holdings"], f"""{PRICES}, {CAL},{flow_sql("asof")}
SELECT CAST(date AS VARCHAR) AS date, {rounded_sql(FLOW_DIGITS)} FROM flow"""))
def panel_etf_flows(spark, sf_dir):
    out = P.flow_block(etf_flows(spark, sf_dir), target_calendar(spark, sf_dir), "asof")
    return dated(rounded(out.select("date", *FLOW_DIGITS), FLOW_DIGITS))


def panel_digits() -> dict[str, int]:
    digits = {}
    for name in ("gold", *P.ASSETS.values()):
        digits[f"{name}_close"] = 2
        digits.update({f"{name}_logret_{k}d": 6 for k in (1, 5, 20)})
        if name != "gold":
            digits[f"{name}_z"] = 6
    digits.update({r: 6 for r in P.RATIOS})
    digits.update({f"{n}_{x}": 6 for n in ("gold", "dxy", "vix") for x in ("yz_20", "yz_5", "vol_regime")})
    digits.update(MACRO_DIGITS)
    digits.update(COT_DIGITS)
    digits.update(FLOW_DIGITS)
    digits.update({c: 6 for c in ("news_impact", "news_intensity", "news_dispersion")})
    digits.update({f"target_logret_{h}d": 6 for h in P.LABELS})
    return digits


NEWS_SQL = """
nj AS (SELECT CAST((n.ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS date, gold_impact AS impact,
         confidence AS conf, greatest(0e0, least(1e0, confidence)) AS w, coalesce(novel, false) AS novel
       FROM news n JOIN news_features f ON n.id = f.news_id
       WHERE gold_impact IS NOT NULL AND confidence IS NOT NULL),
signal AS (SELECT date, coalesce(sum(impact * w) / nullif(sum(w), 0), 0e0) AS impact_wmean,
         count(*) FILTER (conf >= 0.5 AND novel) AS intensity, coalesce(stddev_samp(impact), 0e0) AS dispersion
       FROM nj GROUP BY date)"""


def panel_ctes(calendar: str, mode: str) -> str:
    names = {"GC=F": "gold", **P.ASSETS}
    symbols = ", ".join(f"('{s}')" for s in names)
    wide = []
    for s, n in names.items():
        for f, p in {"close": "close", "r1": "logret_1d", "r5": "logret_5d", "r20": "logret_20d", "z": "z"}.items():
            if not (n == "gold" and f == "z"):
                wide.append(f"max({f}) FILTER (symbol = '{s}') AS {n}_{p}")
    wide += [f"max(t{h}) FILTER (symbol = 'GC=F') AS target_logret_{h}d" for h in P.LABELS]
    yz_wide = [f"max(yz_{k}) FILTER (symbol = '{s}') AS {n}_yz_{k}"
               for s, n in (("GC=F", "gold"), *P.VOLATILITY.items()) for k in (20, 5)]
    yz_cols = [f"{n}_yz_{k}" for n in ("gold", "dxy", "vix") for k in (20, 5)]
    regimes = [f"CASE WHEN {n}_yz_5 / nullif({n}_yz_20, 0) IS NOT NULL THEN "
               f"greatest(0e0, least(5e0, {n}_yz_5 / nullif({n}_yz_20, 0))) END AS {n}_vol_regime"
               for n in ("gold", "dxy", "vix")]
    return f"""{PRICES}, {calendar},
grid AS (SELECT cal.date, s.symbol, p.close FROM cal CROSS JOIN (VALUES {symbols}) AS s(symbol)
         LEFT JOIN prices p ON p.date = cal.date AND p.symbol = s.symbol),
gl AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc FROM grid),
gr AS (SELECT *, lc - lag(lc, 1) OVER w AS r1, lc - lag(lc, 5) OVER w AS r5, lc - lag(lc, 20) OVER w AS r20,
   {", ".join(f"lead(lc, {h}) OVER w - lc AS t{h}" for h in P.LABELS)} FROM gl
   WINDOW w AS (PARTITION BY symbol ORDER BY date)),{rz("gz", "gr", "close", "z", 252, "PARTITION BY symbol")},
gw AS (SELECT date, {", ".join(wide)} FROM gz GROUP BY date),{yz_sql()},
yw AS (SELECT date, {", ".join(yz_wide)} FROM yz GROUP BY date),{aligned("ya", "yw", yz_cols, 2, mode)},
yr AS (SELECT *, {", ".join(regimes)} FROM ya),{macro_sql(mode)},{cot_sql(mode)},{flow_sql(mode)},{NEWS_SQL},
panel AS (SELECT gw.*, {", ".join(f"gold_close / nullif({o}_close, 0) AS {n}" for n, o in P.RATIOS.items())},
   yr.* EXCLUDE (date), macro.* EXCLUDE (date, VIXCLS), cot.* EXCLUDE (date), flow.* EXCLUDE (date),
   coalesce(impact_wmean, 0e0) AS news_impact, coalesce(CAST(intensity AS DOUBLE), 0e0) AS news_intensity,
   coalesce(dispersion, 0e0) AS news_dispersion
   FROM gw LEFT JOIN yr USING (date) LEFT JOIN macro USING (date) LEFT JOIN cot USING (date)
   LEFT JOIN flow USING (date) LEFT JOIN signal USING (date))"""


PANEL_VIEWS = ["prices_d", "macro_d", "cot_disagg", "etf_holdings", "news", "news_features"]


def panel(spark, sf_dir, calendar: str = "target", align_mode: str = "asof", start: str = START):
    signal = N.daily_signal(views.news(spark, sf_dir), views.news_features(spark, sf_dir))
    return P.build_panel(views.prices_d(spark, sf_dir), views.macro_d(spark, sf_dir), views.cot_disagg(spark, sf_dir),
                         etf_flows(spark, sf_dir), signal, start=start, calendar=calendar, align=align_mode)


def stored_panel(spark, sf_dir):
    """The panel written once per data folder and session; jobs that pass over it several times read it back."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = write_through(panel(spark, sf_dir), "panel")
    return _STORED[key]


_STORED: dict = {}


def panel_sql(body: str, calendar: str = CAL, mode: str = "asof") -> str:
    return with_views(PANEL_VIEWS, panel_ctes(calendar, mode) + body)


@query("panel_full", panel_sql(f"\nSELECT CAST(date AS VARCHAR) AS date, {rounded_sql(panel_digits())} FROM panel"))
def panel_full(spark, sf_dir):
    out = panel(spark, sf_dir)
    return dated(rounded(out.select("date", *panel_digits()), panel_digits()))


@query("panel_full_union_calendar", panel_sql(
    f"\nSELECT CAST(date AS VARCHAR) AS date, {rounded_sql(panel_digits())} FROM panel", CAL_ALL, "exact"))
def panel_full_union_calendar(spark, sf_dir):
    out = panel(spark, sf_dir, "union", "exact")
    return dated(rounded(out.select("date", *panel_digits()), panel_digits()))


@query("positioning_signals", with_views(["cot_disagg", "etf_holdings"], """
c AS (SELECT mm_long - mm_short AS x, row_number() OVER (ORDER BY report_date DESC) AS k FROM cot_disagg
      QUALIFY k <= 60),
cm AS (SELECT median(x) AS med FROM c),
cz AS (SELECT 'cot_mm_net' AS signal, CASE WHEN count(*) >= 5 THEN
   CASE WHEN 1.4826e0 * median(abs(x - med)) < 1e-12 THEN 0e0
        ELSE (max(x) FILTER (k = 1) - max(med)) / (1.4826e0 * median(abs(x - med))) END END AS z FROM c, cm),
fh AS (SELECT date, (shares_out - lag(shares_out) OVER (ORDER BY date)) * nav AS flow FROM etf_holdings),
f AS (SELECT date, flow, row_number() OVER (ORDER BY date DESC) AS k FROM fh WHERE flow IS NOT NULL QUALIFY k <= 260),
fs AS (SELECT k, CASE WHEN k >= 5 THEN sum(flow) OVER (ORDER BY k ROWS 4 PRECEDING) END AS x FROM f),
fm AS (SELECT median(x) AS med FROM fs),
fz AS (SELECT 'gld_flow_5d' AS signal, CASE WHEN count(*) >= 10 AND count(x) >= 5 THEN
   CASE WHEN 1.4826e0 * median(abs(x - med)) < 1e-12 THEN 0e0
        ELSE (max(x) FILTER (k = 5) - max(med)) / (1.4826e0 * median(abs(x - med))) END END AS z FROM fs, fm)
SELECT signal, round(z, 2) AS z FROM (SELECT * FROM cz UNION ALL SELECT * FROM fz)"""))
def positioning_signals(spark, sf_dir):
    cot = views.cot_disagg(spark, sf_dir).withColumn("net", F.col("mm_long") - F.col("mm_short"))
    a = robust.latest_robust_z(cot, "net", "report_date", 60, 5)
    b = robust.latest_robust_z(etf_flows(spark, sf_dir), "flow_usd", "date", 260, 10, sum_rows=5)
    return a.select(F.lit("cot_mm_net").alias("signal"), "z").unionByName(
        b.select(F.lit("gld_flow_5d").alias("signal"), "z"))


@query("asof_first_close", with_views(["prices_d"], """
d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
g AS (SELECT DISTINCT symbol FROM prices_d)
SELECT symbol, CAST(day AS VARCHAR) AS day, CAST(min(date) AS VARCHAR) AS hit_date, arg_min(close, date) AS close
FROM d CROSS JOIN g LEFT JOIN prices_d p USING (symbol) WHERE p.date >= d.day GROUP BY ALL"""))
def asof_first_close(spark, sf_dir):
    prices = views.prices_d(spark, sf_dir)
    days = views.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    symbols = [*views.SYMBOL_OF_PRIORITY.values(), "CL=F"]
    rows = days.withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in symbols])))
    out = align.first_on_or_after(rows, prices, "day").where(F.col("close").isNotNull())
    return dated(out.select("symbol", "day", "hit_date", "close"), "day", "hit_date")


@query("asof_panel_row", with_views(["prices_d"], """
d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS asked FROM lineitem),
g AS (SELECT date, close FROM prices_d WHERE symbol = 'GC=F')
SELECT CAST(asked AS VARCHAR) AS asked, CAST(date AS VARCHAR) AS date, close FROM d ASOF JOIN g ON d.asked >= g.date"""))
def asof_panel_row(spark, sf_dir):
    rows = views.prices_d(spark, sf_dir).where(F.col("symbol") == "GC=F").select("date", "close")
    days = views.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("asked")).distinct()
    out = align.last_on_or_before(rows, days, asof_col="asked")
    return dated(out.select("asked", "date", "close"), "asked", "date")


@query("asof_last_tick", with_views(["ticks"], """
o AS (SELECT event_id, ts, concat('S', (user_id + 1) % 5) AS symbol FROM events)
SELECT o.event_id, o.symbol, t.mid FROM o ASOF LEFT JOIN ticks t ON o.symbol = t.symbol AND o.ts >= t.ts"""))
def asof_last_tick(spark, sf_dir):
    t = views.ticks(spark, sf_dir).select("symbol", "ts", "mid")
    probe = views.table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("S"), (F.col("user_id") + 1) % 5).alias("symbol"))
    return align.asof_join(probe, t, ("symbol",), "ts", ["mid"], "event_id").select("event_id", "symbol", "mid")


@query("asof_next_tick", with_views(["ticks"], """
o AS (SELECT event_id, ts, concat('S', (user_id + 1) % 5) AS symbol FROM events)
SELECT o.event_id, o.symbol, t.mid FROM o ASOF LEFT JOIN ticks t ON o.symbol = t.symbol AND o.ts <= t.ts"""))
def asof_next_tick(spark, sf_dir):
    t = views.ticks(spark, sf_dir).select("symbol", "ts", "mid")
    probe = views.table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("S"), (F.col("user_id") + 1) % 5).alias("symbol"))
    return align.asof_join(probe, t, ("symbol",), "ts", ["mid"], "event_id", "forward").select(
        "event_id", "symbol", "mid")


@query("fusion_latest_values", with_views(["ticks", "news"], """
m AS (SELECT ts, event_id, value FROM events WHERE event_type = 'error'),
n AS (SELECT ts, length(title) AS value FROM news)
SELECT t.event_id, t.mid, n.value AS text, m.value AS macro FROM ticks t
ASOF LEFT JOIN n ON t.ts >= n.ts ASOF LEFT JOIN m ON t.ts >= m.ts"""))
def fusion_latest_values(spark, sf_dir):
    t = views.ticks(spark, sf_dir).select("ts", "event_id", "mid")
    text = views.news(spark, sf_dir).select("ts", F.length("title").cast("long").alias("value"))
    macro = views.table(spark, sf_dir, "events").where(F.col("event_type") == "error").select("ts", "event_id", "value")
    return align.latest_value_fusion(t, {"text": text, "macro": macro}).select("event_id", "mid", "text", "macro")


@query("tick_horizon_returns", with_views(["ticks"], f"""
r AS (SELECT event_id, symbol, ln(lead(mid, 5) OVER w / mid) AS realised_5, ln(lead(mid, 30) OVER w / mid) AS realised_30
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))
SELECT event_id, symbol, {rounded_sql({"realised_5": 6, "realised_30": 6})} FROM r"""))
def tick_horizon_returns(spark, sf_dir):
    from tidemark.operators import ticks as T
    from tidemark.operators.blocks import ticks_order

    out = align.tick_horizon(T.numbered_ticks(views.ticks(spark, sf_dir)), (5, 30), ticks_order())
    return rounded(out.select("event_id", "symbol", "realised_5", "realised_30"), {"realised_5": 6, "realised_30": 6})


@query("forward_fill_limit", with_views(["macro_d"], """
c AS (SELECT DISTINCT date FROM macro_d),
g AS (SELECT c.date, m.value FROM c LEFT JOIN macro_d m ON m.date = c.date AND m.series_id = 'DGS2' AND m.value > 5),
f AS (SELECT date, last_value(value IGNORE NULLS) OVER (ORDER BY date ROWS 3 PRECEDING) AS value FROM g)
SELECT CAST(date AS VARCHAR) AS date, value FROM f"""))
def forward_fill_limit(spark, sf_dir):
    m = views.macro_d(spark, sf_dir)
    hits = m.where((F.col("series_id") == "DGS2") & (F.col("value") > 5)).select("date", "value")
    out = align.forward_fill(m.select("date").distinct().join(hits, "date", "left"), ["value"], 3)
    return dated(out.select("date", "value"))


@query("tail_align", with_views(["macro_d"], """
x AS (SELECT value, row_number() OVER (ORDER BY date DESC) AS back FROM macro_d WHERE series_id = 'DGS10'),
y AS (SELECT value, row_number() OVER (ORDER BY date DESC) AS back FROM macro_d WHERE series_id = 'VIXCLS')
SELECT x.back, x.value AS x, y.value AS y FROM x JOIN y USING (back) WHERE back <= 120"""))
def tail_align(spark, sf_dir):
    m = views.macro_d(spark, sf_dir)
    pick = lambda s: m.where(F.col("series_id") == s)
    out = align.tail_align(pick("DGS10"), pick("VIXCLS"), at="date")
    return out.withColumn("back", F.col("back").cast("long"))
