"""Distribution drift between two samples, and permutation importance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import d
from tidemark.operators.blocks import Order, index_rows
from tidemark.session import write_through


def _long(df: DataFrame, cols: list[str], recent: bool) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    rows = df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    return rows.select("feature", "x", F.lit(int(recent)).alias("recent"))


def ks_drift(base: DataFrame, recent: DataFrame, cols: list[str], least: tuple[int, int] = (30, 20),
             p_limit: float = 0.01, d_limit: float = 0.15, buckets: int = 64) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per feature, worst first.

    Values are counted first, so repeats collapse before the sort. The cumulative counts run inside
    quantile buckets of each feature with bucket totals carried over, so a feature is never in one task.
    The p-value is asymptotic.
    """
    values = _long(base, cols, False).unionByName(_long(recent, cols, True)).groupBy("feature", "x").agg(
        F.sum(1 - F.col("recent")).alias("a"), F.sum("recent").alias("b"))
    values = write_through(values, "drift")  # read three times below
    edges = values.groupBy("feature").agg(F.percentile_approx(
        "x", [i / buckets for i in range(1, buckets)], 10_000).alias("edges"))
    tagged = values.join(F.broadcast(edges), "feature").withColumn(
        "bucket", F.size(F.filter("edges", lambda e: e < F.col("x")))).drop("edges")
    sums = tagged.groupBy("feature", "bucket").agg(F.sum("a").alias("ba"), F.sum("b").alias("bb"))
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    carried = sums.select(
        "feature", "bucket", F.coalesce(F.sum("ba").over(before), F.lit(0)).alias("pa"),
        F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("pb"),
        F.sum("ba").over(whole).alias("na"), F.sum("bb").over(whole).alias("nb"))
    w = Window.partitionBy("feature", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    j = tagged.join(F.broadcast(carried), ["feature", "bucket"]).where(
        (F.col("na") >= least[0]) & (F.col("nb") >= least[1]))
    gap = F.abs((F.col("pa") + F.sum("a").over(w)) / F.col("na") - (F.col("pb") + F.sum("b").over(w)) / F.col("nb"))
    out = j.withColumn("gap", gap).groupBy("feature").agg(
        F.max("gap").alias("d_stat"), F.max("na").alias("n_base"), F.max("nb").alias("n_recent"))
    out = out.withColumn("p_value", ks_p_value(F.col("d_stat"), F.col("n_base"), F.col("n_recent")))
    return out.withColumn("drifted", (F.col("p_value") < p_limit) | (F.col("d_stat") > d_limit)).orderBy(
        F.desc("d_stat"), "feature")


def ks_p_value(stat: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: 2 * sum over k of (-1)^(k-1) exp(-2 k^2 t^2)."""
    en = F.sqrt(n.cast("double") * m / (n + m))
    t = en * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), d(0),
        lambda acc, k: acc + F.when(k % 2 == 1, d(1)).otherwise(d(-1)) * F.exp(-2.0 * k * k * t * t))
    return F.when(t < 0.2, d(1)).otherwise(F.least(F.greatest(2.0 * series, d(0)), d(1)))


def _hash_numbered(rows: DataFrame, key: Column) -> DataFrame:
    """Number the rows of each pair in the order of the key's MD5, in chunks of its range."""
    order = Order(("pair",), ("_h", "id"), F.shiftright("_h", 48))
    return index_rows(rows.withColumn("_h", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")), order, "k").drop("_h")


def permutation_importance(df: DataFrame, features: list[str], y: str, score: Callable[[dict[str, Column]], Column],
                           row_id: str, repeats: int = 5, seed: int = 0, label_loss=None) -> DataFrame:
    """Increase of the median forecast's pinball loss when one feature is shuffled, averaged over repeats.

    `score` builds the forecast from a mapping feature -> column. All (feature, repeat) pairs run in one
    job: rows are numbered once, and each pair takes its values from the row a hashed order assigns.
    """
    from tidemark.functions.numeric import pinball

    loss = label_loss or (lambda y_, p_: pinball(y_, p_, 0.5))
    plain = {f: F.coalesce(F.col(f).cast("double"), d(0)) for f in features}
    base = df.agg(F.avg(loss(F.col(y), score(plain))).alias("_base")).withColumn("_base", F.col("_base") + 1e-9)

    n_pairs = len(features) * repeats
    pair = F.explode(F.sequence(F.lit(0), F.lit(n_pairs - 1))).alias("pair")
    rows = df.select(F.col(row_id).alias("id"), F.col(y).alias("_y"), *[plain[f].alias(f) for f in features], pair)
    chosen = F.element_at(F.array(*[F.col(f) for f in features]), (F.floor(F.col("pair") / repeats) + 1).cast("int"))
    own = _hash_numbered(rows, F.col("id").cast("string"))
    mixed = _hash_numbered(rows.select("pair", "id", chosen.alias("_mixed")), F.concat_ws("|", F.lit(str(seed)), F.col("pair").cast("string"), F.col("id").cast("string")))
    mixed = mixed.select("pair", "_mixed", "k")
    both = own.join(mixed, ["pair", "k"])
    at = F.floor(F.col("pair") / repeats)
    swapped = {f: F.when(at == i, F.col("_mixed")).otherwise(F.col(f)) for i, f in enumerate(features)}
    losses = both.groupBy("pair").agg(F.avg(loss(F.col("_y"), score(swapped))).alias("loss"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), (F.floor(F.col("pair") / repeats) + 1).cast("int"))
    return (losses.withColumn("feature", names).crossJoin(F.broadcast(base)).groupBy("feature")
            .agg(F.avg(F.col("loss") - F.col("_base")).alias("delta_pinball"), F.max("_base").alias("_base"))
            .select("feature", "delta_pinball", (F.col("delta_pinball") / F.col("_base")).alias("relative"))
            .orderBy(F.desc("delta_pinball"), "feature"))
