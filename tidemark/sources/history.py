"""Parsers for historical downloads: macro series, futures positioning, fund holdings, daily bars, statements."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Target column -> normalised header names in the yearly positioning files.
COT_HEADERS = {
    "open_interest": ("open_interest_all",),
    "mm_long": ("m_money_positions_long_all",),
    "mm_short": ("m_money_positions_short_all",),
    "mm_spread": ("m_money_positions_spread_all",),
    "swap_long": ("swap_positions_long_all",),
    "swap_short": ("swap_positions_short_all",),
    "producer_long": ("prod_merc_positions_long_all",),
    "producer_short": ("prod_merc_positions_short_all",),
    "other_rep_long": ("other_rept_positions_long_all",),
    "other_rep_short": ("other_rept_positions_short_all",),
    "nonrep_long": ("nonrept_positions_long_all",),
    "nonrep_short": ("nonrept_positions_short_all",),
}
COT_CODE_HEADERS = ("cftc_contract_market_code",)
COT_DATE_HEADERS = ("report_date_as_yyyy-mm-dd", "report_date_as_mm_dd_yyyy")
GOLD_CODE = "088691"


def macro_observations(df: DataFrame, line: str = "line") -> DataFrame:
    """(date, series_id, value) from observation replies; '.' and unreadable values or dates are dropped."""
    m = df.withColumn("m", F.from_json(line, "series_id string, observations array<struct<date:string,value:string>>"))
    o = m.select(F.col("m.series_id").alias("series_id"), F.explode("m.observations").alias("o"))
    return (o.select(F.col("o.date").try_cast("date").alias("date"), "series_id",
                     F.col("o.value").try_cast("double").alias("value"))
            .where(F.col("date").isNotNull() & F.col("value").isNotNull()))


def normalised_header(name: str) -> str:
    return re.sub("_+", "_", name.lower().strip()).replace(" ", "_")


def _find(columns: list[str], names: tuple[str, ...]) -> str | None:
    by_header = {}
    for c in columns:
        by_header.setdefault(normalised_header(c), c)
    return next((by_header[n] for n in names if n in by_header), None)


def positioning(wide: DataFrame, code: str = GOLD_CODE, contract: str = "GOLD_COMEX") -> DataFrame:
    """One yearly positioning file, read with its header as strings, to the standard columns."""
    code_col, date_col = _find(wide.columns, COT_CODE_HEADERS), _find(wide.columns, COT_DATE_HEADERS)
    if code_col is None or date_col is None:
        raise ValueError(f"positioning file without contract code or report date: {wide.columns[:8]}")
    rows = wide.where(F.trim(F.col(f"`{code_col}`").cast("string")) == code)
    text = F.col(f"`{date_col}`").cast("string")
    date = F.coalesce(text.try_cast("date"), F.to_date(F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))))
    values = []
    for target, headers in COT_HEADERS.items():
        found = _find(wide.columns, headers)
        value = F.trim(F.col(f"`{found}`").cast("string")).try_cast("double") if found else F.lit(None).cast("double")
        values.append(value.alias(target))
    return rows.select(date.alias("report_date"), F.lit(contract).alias("contract"), *values).where(
        F.col("report_date").isNotNull())


def read_positioning(spark: SparkSession, paths: list[str], code: str = GOLD_CODE) -> DataFrame:
    """Yearly files differ in their headers, so each is mapped on its own and the results united."""
    frames = [positioning(spark.read.csv(p, header=True, encoding="ISO-8859-1"), code) for p in paths]
    return reduce(DataFrame.unionByName, frames)


def fund_flows(holdings: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Assets and net flow of a fund from its shares and net asset value, by date within ticker."""
    w = Window.partitionBy(*keys).orderBy("date")
    return holdings.withColumns({
        "aum_usd": F.col("shares_out") * F.col("nav"),
        "flow_usd": (F.col("shares_out") - F.lag("shares_out").over(w)) * F.col("nav"),
    })


def fund_holdings(wide: DataFrame, ticker: str = "GLD") -> DataFrame:
    """Pick date, tonnes, NAV and shares columns of a holdings export by what their names contain."""
    names = {c: c.strip() for c in wide.columns}

    def pick(*parts: str) -> str | None:
        return next((c for c, n in names.items() if any(p in n for p in parts)), None)

    date, tonnes, nav = pick("Date"), pick("Tonnes"), pick("NAV", "Per Share")
    shares = pick("Shares", "Ounces")
    if not (date and tonnes and nav):
        raise ValueError(f"unexpected holdings layout: {wide.columns}")

    def number(c: str | None):
        return F.trim(F.col(f"`{c}`").cast("string")).try_cast("double") if c else F.lit(None).cast("double")

    text = F.trim(F.col(f"`{date}`").cast("string"))
    day = F.coalesce(text.try_cast("date"), F.to_date(F.try_to_timestamp(text, F.lit("dd-MMM-yyyy"))))
    rows = wide.select(day.alias("date"), F.lit(ticker).alias("ticker"), number(tonnes).alias("holdings_tonnes"),
                       number(shares).alias("shares_out"), number(nav).alias("nav")).where(F.col("date").isNotNull())
    return fund_flows(rows)


def long_bars(wide: DataFrame, symbols: list[str], source: str = "yahoo") -> DataFrame:
    """A wide frame with columns like `GC=F|Open` to one row per date and symbol."""
    fields = ["Open", "High", "Low", "Close", "Volume"]
    bars = []
    for s in symbols:
        values = [(F.col(f"`{s}|{f}`") if f"{s}|{f}" in wide.columns else F.lit(None)).cast("double").alias(f.lower())
                  for f in fields]
        bars.append(F.struct(F.lit(s).alias("symbol"), *values))
    rows = wide.select(F.to_date("date").alias("date"), F.explode(F.array(*bars)).alias("b"))
    return (rows.select("date", "b.*", F.lit(source).alias("source"))
            .where(F.coalesce("open", "high", "low", "close", "volume").isNotNull()))


def statement_dates(pages: DataFrame, text: str = "html") -> DataFrame:
    """Distinct meeting dates named by statement links in index pages."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"monetary(\d{8})a\.htm"), F.lit(1)))
    days = pages.select(found.alias("day"))
    dates = days.select(F.to_date(F.try_to_timestamp("day", F.lit("yyyyMMdd"))).alias("date"))
    return dates.where(F.col("date").isNotNull()).distinct()
