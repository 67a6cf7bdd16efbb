"""Lake tables as partitioned parquet: typed scans, keyed upserts, run records, fingerprints, caches.

A table folder is partitioned by `_part`, a function of the key: the year for tables keyed by a date,
a hash bucket otherwise. An upsert rewrites only the partitions that hold a key of its batch (dynamic
partition overwrite) and appends to the others; one writer per table at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.bars import dedup_by_max
from tidemark.schemas import KEYS, TABLES

HASH_PARTS = 64
#: An upsert merges a partition of more files than this if they are smaller on average than that many bytes.
MANY_FILES, SMALL_FILE, MERGED_FILE = 1000, 16 << 20, 64 << 20


def same_again(df: DataFrame) -> bool:
    """Whether Spark takes another reading to give the same rows in the same order: a micro-batch without a shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.nodeName() == "LogicalRDD" and plan.rdd().outputDeterministicLevel().toString() == "DETERMINATE"


def last_numbers(batch: DataFrame, keys: list[str], number: str) -> DataFrame:
    return batch.groupBy(*keys).agg(F.max(number).alias(number))


def last_rows(batch: DataFrame, keys: list[str], number: str, last: DataFrame | None = None) -> DataFrame:
    """The row with the largest `number` of each key, without `number`: a different long >= 0 in each row of `batch`.

    Only keys and numbers are shuffled, the rows stay where they are: a bit for each row, in blocks of 32,768 that the
    rows look up, tells which to keep. `batch` is read twice and must give the same numbers both times. `last` are its
    `last_numbers` if they are known.
    """
    last = last_numbers(batch, keys, number) if last is None else last
    bits = last.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = batch.withColumns({"_bucket": F.bitmap_bucket_number(number)}).join(F.broadcast(bits), "_bucket")
    kept = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(at, F.lit(8)).cast("int"))) != 0
    return rows.where(kept).drop("_bucket", "_bits", number)


def upsert_rows(target: DataFrame, batch: DataFrame, keys: list[str], seq: str | None = None, unique: bool = False,
                known: DataFrame | None = None) -> DataFrame:
    """The target after inserting the batch and overwriting non-key columns on equal keys.

    The last duplicate within the batch wins, by `seq` (default: row order of the batch). Columns the
    batch lacks keep the stored value, or null on insert. If the batch has key columns only, stored
    rows stay as they are. The stored side is anti-joined, never grouped: a small batch is broadcast.
    `unique` says that no key comes twice in the batch, `known` are its keys if they are stored apart.
    """
    if seq is None and not unique:
        seq = "_seq"
        batch = batch.withColumn(seq, F.monotonically_increasing_id())
    values = [c for c in target.columns if c not in keys]
    given = [c for c in values if c in batch.columns]
    if not given:
        new = batch.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")
        return target.unionByName(new, allowMissingColumns=True)
    latest = batch.select(*keys, *given) if unique else dedup_by_max(batch.select(*keys, *given, seq), keys, seq)
    missing = [c for c in values if c not in given]
    if missing:
        latest = latest.join(target.select(*keys, *missing), keys, "left")
    kept = target.join(latest.select(*keys) if known is None else known, keys, "left_anti")
    casts = [F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema]
    return kept.unionByName(latest.select(*casts))


def part_of(table: str) -> Column:
    keys = KEYS[table]
    dated = [k for k in keys if k.endswith("date")]
    if dated:
        return F.year(dated[0])
    return F.pmod(F.xxhash64(*keys), F.lit(HASH_PARTS)).cast("int")


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def _stored(self, table: str) -> DataFrame:
        schema = StructType([*TABLES[table], StructField("_part", IntegerType())])
        if not self._exists(self.path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def read(self, table: str, since: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Typed scan with an optional lower date bound and column list; both reach the parquet reader."""
        df = self._stored(table)
        dated = [k for k in KEYS[table] if k.endswith("date")]
        if since and dated:
            df = df.where((F.col("_part") >= F.year(F.lit(since).cast("date")))
                          & (F.col(dated[0]) >= F.lit(since).cast("date")))
        return df.select(*(columns or [f for f in df.columns if f != "_part"]))

    def _merged_files(self, table: str, part: int) -> int:
        """The files that a partition of too many small ones should have; 0 if it may stay as it is."""
        path = f"{self.path(table)}/_part={part}"
        if not self._exists(path):
            return 0
        fs, p = self._at(path)
        held = fs.getContentSummary(p)
        few = held.getFileCount() <= MANY_FILES or held.getLength() >= SMALL_FILE * held.getFileCount()
        return 0 if few else -(-held.getLength() // MERGED_FILE) or 1

    def _aside(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def upsert(self, table: str, batch: DataFrame, seq: str | None = None) -> None:
        """Insert the batch and overwrite equal keys; the last duplicate within the batch wins (see `upsert_rows`).

        No row of the batch is held in memory: it is read once for its keys, which are written aside, and again for its
        rows, or written aside whole if another reading may differ. Partitions without any of its keys get more files,
        written from where the rows are unless `seq` orders them; the others are rewritten, their stored rows shuffled
        once, and so are those of too many small files, whose rows are shuffled once more.
        """
        keys, unique = KEYS[table], seq is None
        again, seq = same_again(batch), seq or "_seq"
        if unique:
            batch = batch.withColumn(seq, F.monotonically_increasing_id())
        untyped = {c for c, kind in batch.dtypes if kind == "void"}
        given = dict.fromkeys([*keys, *[c for c in batch.columns if c in TABLES[table].names], seq])
        batch = batch.select(*[F.col(c).cast("string").alias(c) if c in untyped else c for c in given])
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        try:
            batch = batch if again else self._aside(batch, f"{aside}/rows")
            last = self._aside(last_numbers(batch, keys, seq), f"{aside}/keys")
            typed = last.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table] if f.name in keys])
            parts = {r[0] for r in typed.select(part_of(table).alias("p")).distinct().collect()}
            if not parts:
                return
            known = last.select(*keys)
            stored = self._stored(table).where(F.col("_part").isin(sorted(parts - {None})))
            met = stored.select(*keys, "_part").join(known, keys, "left_semi").select("_part").distinct()
            files = {p: self._merged_files(table, p) for p in parts - {None}}
            whole = {r[0] for r in met.collect()} | {p for p, n in files.items() if n}
            new = sorted(parts - {None} - whole)
            latest = last_rows(batch, keys, seq, last) if unique else batch
            dest = self.path(table)
            appended = F.coalesce(F.col("_part").isin(new), F.lit(False))
            if len(new) < len(parts):
                touched = stored.where(F.col("_part").isin(sorted(whole))).drop("_part")
                merged = upsert_rows(touched.repartition(*keys), latest, keys, seq, unique, known)
                merged = merged.withColumn("_part", part_of(table)).where(~appended)
                if any(files.values()):
                    merged = merged.repartition("_part", F.pmod(F.xxhash64(*keys), F.lit(max(files.values()))))
                (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                 .partitionBy("_part").parquet(dest))
            if new:
                empty = self.spark.createDataFrame([], TABLES[table]).limit(0)  # the optimizer sees that it is empty
                merged = upsert_rows(empty, latest, keys, seq, unique, known).withColumn("_part", part_of(table))
                merged = merged if len(new) == len(parts) else merged.where(appended)
                merged.write.mode("append").option("compression", "zstd").partitionBy("_part").parquet(dest)
        finally:
            fs, p = self._at(aside)
            fs.delete(p, True)

    def row_counts(self) -> DataFrame:
        return row_counts({t: self.read(t) for t in TABLES})

    def start_run(self, source: str, notes: str = "") -> str:
        run_id = uuid.uuid4().hex
        self._record(run_id, source, notes, "started_at", 0)
        return run_id

    def record_rows(self, run_id: str, rows: int, source: str = "") -> None:
        self._record(run_id, source, "", None, rows)

    def finish_run(self, run_id: str, source: str = "") -> None:
        self._record(run_id, source, "", "finished_at", 0)

    def _record(self, run_id: str, source: str, notes: str, stamp: str | None, rows: int) -> None:
        now, none = F.current_timestamp(), F.lit(None).cast("timestamp")
        row = self.spark.range(1).select(
            F.lit(run_id).alias("run_id"), (now if stamp == "started_at" else none).alias("started_at"),
            (now if stamp == "finished_at" else none).alias("finished_at"),
            F.nullif(F.lit(source), F.lit("")).alias("source"), F.lit(rows).cast("int").alias("rows_added"),
            F.nullif(F.lit(notes), F.lit("")).alias("notes"))
        row.write.mode("append").parquet(f"{self.root}/lake_runs_log")

    def runs(self) -> DataFrame:
        return run_report(self.spark.read.schema(TABLES["lake_runs"]).parquet(f"{self.root}/lake_runs_log"))

    def cached(self, name: str, fingerprint: str, build) -> DataFrame:
        """The stored result for this fingerprint, built and written on first use."""
        path = f"{self.root}/cache/{name}/{fingerprint}"
        if not self._exists(f"{path}/_SUCCESS"):
            build().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.parquet(path)


def run_report(log: DataFrame) -> DataFrame:
    """One row per run from appended records: start, finish, rows added."""
    return log.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
        F.max("source").alias("source"), F.sum("rows_added").alias("rows_added"), F.max("notes").alias("notes"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def fingerprint(tables: dict[str, tuple[DataFrame, str]], *context: str | None) -> DataFrame:
    """One 16-character hash of row counts and newest dates of the tables, plus context strings.

    `tables` maps a name to (frame, date column). One row per table is combined.
    """
    parts = [df.agg(F.concat_ws(":", F.lit(t), F.count("*").cast("string"),
                                F.coalesce(F.max(c).cast("string"), F.lit("none"))).alias("part"))
             for t, (df, c) in tables.items()]
    joined = reduce(DataFrame.unionByName, parts).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    head = F.lit("|".join(str(c) for c in context))
    return joined.select(F.substring(F.sha2(F.concat_ws("|", head, F.array_join("parts", "|")), 256), 1, 16)
                         .alias("fingerprint"))
