"""Point-in-time alignment: as-of joins, calendar alignment, limited forward fill, latest-value fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import Order, running, time_chunk
from tidemark.operators.ranges import ranged_running


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], ts: str, values: list[str],
              left_id: str, direction: str = "backward", grain_seconds: int = 3600,
              matched_ts: str | None = None) -> DataFrame:
    """Attach to each left row the nearest right row at or before (or at or after) its timestamp.

    The two sides are united and scanned in time slices; a carried value per slice replaces the range
    join, so neither a busy key nor a long gap concentrates rows. `left_id` makes left rows unique and
    the right side has at most one row per key and timestamp.
    """
    backward = direction == "backward"
    matched = matched_ts or f"{ts}_matched"
    payload = F.struct(F.col(ts).alias(matched), *values)
    empty = F.lit(None).cast(right.select(payload.alias("v")).schema["v"].dataType)
    # On equal timestamps the right row comes first in scan order.
    left_side, right_side = (1, 0) if backward else (0, 1)
    l_rows = left.select(*keys, ts, F.lit(left_side).alias("_side"), F.col(left_id).cast("string").alias("_id"),
                         F.struct(*[c for c in left.columns if c not in (*keys, ts)]).alias("_left"),
                         empty.alias("_right"))
    r_rows = right.select(*keys, ts, F.lit(right_side).alias("_side"), F.lit("").alias("_id"),
                          F.lit(None).cast(l_rows.schema["_left"].dataType).alias("_left"), payload.alias("_right"))
    order = Order(keys, (ts, "_side", "_id"), time_chunk(ts, grain_seconds), reverse=not backward)
    out = running(l_rows.unionByName(r_rows), order, {"_hit": ("last", F.col("_right"))})
    return (out.where(F.col("_side") == left_side)
            .select(*keys, ts, "_left.*", "_hit.*"))


def first_on_or_after(rows: DataFrame, prices: DataFrame, day: str, keys: tuple[str, ...] = ("symbol",),
                      date: str = "date", values: tuple[str, ...] = ("close",)) -> DataFrame:
    """Forward as-of join of daily data: the first price row dated `day` or later (null if none).

    Every price row answers for the days after the previous one, so spelling those days out turns the
    as-of join into an equality join on (key, day). That table has one row per key and calendar day. Of several
    rows of one key and date the one with the largest values counts.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    prev = F.lag(date).over(w)
    one = prices.groupBy(*keys, date).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, date, "_v.*")
    spans = one.select(*keys, F.col(date).alias("_hit_date"), *values, F.date_add(prev, 1).alias("_from"))
    answers = spans.select(*keys, "_hit_date", *values, F.explode(F.sequence(
        F.coalesce("_from", "_hit_date"), "_hit_date")).alias(day))
    # Days before the first price: its first row answers those, whatever the distance.
    first = spans.where(F.col("_from").isNull()).select(
        *keys, *[F.col(c).alias(f"_first_{c}") for c in ("_hit_date", *values)])
    out = rows.join(answers, [*keys, day], "left").join(first, list(keys), "left")
    early = F.col(day) < F.col("_first__hit_date")
    cols = {("hit_date" if c == "_hit_date" else c): F.when(early, F.col(f"_first_{c}")).otherwise(F.col(c))
            for c in ("_hit_date", *values)}
    return out.withColumns(cols).drop("_hit_date", *[f"_first_{c}" for c in ("_hit_date", *values)])


def last_on_or_before(panel: DataFrame, asof: DataFrame, date: str = "date", asof_col: str = "asof") -> DataFrame:
    """Backward as-of for a panel: its row (or rows) of the date in force on each asked-for day.

    Each panel row is valid until the next, so the days in between are spelled out only up to the
    last asked-for day and joined by equality.
    """
    w = Window.orderBy(date)  # one row per date
    last_asked = asof.agg(F.max(asof_col).alias("_end"))
    spans = (panel.select(date).distinct().select(F.col(date).alias("_from"), F.date_sub(F.lead(date).over(w), 1).alias("_to"))
             .crossJoin(F.broadcast(last_asked))
             .withColumn("_to", F.coalesce(F.col("_to"), F.greatest("_end", "_from"))))
    days = spans.select(F.col("_from").alias(date), F.explode(F.sequence("_from", "_to")).alias(asof_col))
    return asof.join(days, asof_col).join(panel, date)


def forward_fill(df: DataFrame, cols: list[str], limit: int, keys: tuple[str, ...] = (),
                 at: str = "date") -> DataFrame:
    """Carry the last non-null value over at most `limit` rows. For daily frames: one row per key and date."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(at)
    frame = w.rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in cols})


def calendar_align(calendar: DataFrame, series: DataFrame, cols: list[str], limit: int, at: str = "date",
                   mode: str = "asof") -> DataFrame:
    """Put a sparse series on the calendar rows and carry each value over at most `limit` calendar rows.

    mode='exact' keeps only observations dated on a calendar day (others are lost); mode='asof' moves
    an off-calendar observation to the next calendar day, where it first becomes usable.
    """
    if mode == "exact":
        placed = series.select(at, *cols)
    else:
        w = Window.orderBy(at)  # one row per calendar day
        spans = calendar.select(at, F.lag(at).over(w).alias("_prev"))
        days = spans.select(at, F.explode(F.sequence(F.coalesce(F.date_add("_prev", 1), F.col(at)), at)).alias("_day"))
        placed = (series.withColumnRenamed(at, "_day").join(days, "_day").groupBy(at)
                  .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_day"))).alias(c) for c in cols]))
    return forward_fill(calendar.select(at).join(placed, at, "left"), cols, limit, at=at)


def latest_value_fusion(ticks: DataFrame, feeds: dict[str, DataFrame], ts: str = "ts", tie: str = "event_id",
                        keys: tuple[str, ...] = ()) -> DataFrame:
    """At every tick the newest row of each feed (null before the first), over ranges of equal size whatever the times.

    Feeds have columns ts, value (and the keys, if any); `value` may be a struct. One union and one
    scan serve all feeds.
    """
    body = F.struct(*[c for c in ticks.columns if c not in (*keys, ts, tie)])
    base = ticks.select(*keys, ts, tie, F.lit(len(feeds)).alias("_side"), body.alias("_tick"))
    tick_type = base.schema["_tick"].dataType
    types = {n: f.schema["value"].dataType for n, f in feeds.items()}
    rows = base.withColumns({f"_f_{n}": F.lit(None).cast(t) for n, t in types.items()})
    for i, (name, feed) in enumerate(feeds.items()):
        own_tie = F.col(tie) if tie in feed.columns else F.lit(0)
        part = feed.select(*keys, ts, own_tie.cast(ticks.schema[tie].dataType).alias(tie), F.lit(i).alias("_side"),
                           F.lit(None).cast(tick_type).alias("_tick"), F.col("value").alias("_value"))
        part = part.withColumns({f"_f_{n}": F.col("_value") if n == name else F.lit(None).cast(t)
                                 for n, t in types.items()}).drop("_value")
        rows = rows.unionByName(part)
    out = ranged_running(rows, list(keys), [ts, "_side", tie], {n: ("last", F.col(f"_f_{n}")) for n in feeds})
    return (out.where(F.col("_side") == len(feeds))
            .select(*keys, ts, tie, "_tick.*", *feeds))


def tick_horizon(ticks: DataFrame, horizons: tuple[int, ...], order: Order, size: int = 16384,
                 price: str = "mid") -> DataFrame:
    """Log return realised h ticks later, per horizon (null while pending). Expects numbered ticks."""
    from tidemark.operators.blocks import block_window, own_rows, with_blocks

    w = block_window(order.keys)
    out = with_blocks(ticks, size, 0, max(horizons))
    return own_rows(out.withColumns({
        f"realised_{h}": F.log(F.lead(price, h).over(w) / F.col(price)) for h in horizons}))


def tail_align(x: DataFrame, y: DataFrame, at: str = "ts", value: str = "value", by: str = "count",
               window: int = 120) -> DataFrame:
    """Pair the last `window` values of two series: by count from the end, or by equal time."""
    if by == "time":
        return (x.select(at, F.col(value).alias("x")).join(y.select(at, F.col(value).alias("y")), at)
                .orderBy(F.desc(at)).limit(window))

    def tail(df: DataFrame, name: str) -> DataFrame:
        last = df.orderBy(F.desc(at)).limit(window)  # top-k, no full sort
        w = Window.orderBy(F.desc(at))
        return last.select(F.row_number().over(w).alias("back"), F.col(value).alias(name))

    return tail(x, "x").join(tail(y, "y"), "back")

