"""Scans, sinks and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, finite_positive, twelve_digits
from .schemas import BAR_DEFAULTS, TICK_CSV
from .staging import staged


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``. "Last row wins" needs an explicit order; ties in it are resolved arbitrarily.

    The rank is computed over the key only, so partial results never meet in one task unless one key does.
    """
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def merge_upsert(target: DataFrame, incoming: DataFrame, keys: list[str], ts: str, start_ms: int, end_ms: int, seq: str) -> DataFrame:
    """Incoming rows within [start, end) replace target rows of the same key; the highest ``seq`` wins among incoming rows."""
    fresh = incoming.where((F.col(ts) >= start_ms) & (F.col(ts) < end_ms))
    both = target.withColumn("_version", F.lit(0)).unionByName(fresh.withColumn("_version", F.lit(1)))
    return latest(both, keys, [F.col("_version"), F.col(seq)]).drop("_version")


def lenient_scan(raw: DataFrame, *, interval_ms: int, symbol: str, source: str, seq: str = "seq") -> DataFrame:
    """Bars with defaults for missing columns and nulls, rows without a readable time dropped, the last row of a time kept.

    Symbols are upper case, sources trimmed lower case; blanks take the fallbacks. Columns of other names are dropped.
    """
    have = set(raw.columns)
    get = lambda c, kind: F.expr(f"try_cast(`{c}` as {kind})") if c in have else F.lit(None).cast(kind)
    text = lambda c, fallback: F.coalesce(F.when(F.trim(get(c, "string")) != "", F.trim(get(c, "string"))), F.lit(fallback))
    rows = raw.select(
        F.upper(text("symbol", symbol)).alias("symbol"),
        get("timestamp_ms", "bigint").alias("timestamp_ms"),
        *(F.coalesce(get(c, "bigint" if d == 0 and isinstance(d, int) else "double"), F.lit(d)).alias(c) for c, d in BAR_DEFAULTS.items()),
        F.lit(interval_ms // 1000).alias("interval_seconds"),
        F.lower(text("source", source)).alias("source"),
        F.col(seq).alias("_seq"),
    ).where("timestamp_ms is not null")
    return latest(rows, ["symbol", "timestamp_ms"], [F.col("_seq")]).drop("_seq")


def tick_csv_scan(spark: SparkSession, path: str, *, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Ticks of headerless ``ts_seconds,price,volume`` files; malformed, short and non-finite lines are dropped."""
    rows = spark.read.schema(TICK_CSV).option("mode", "DROPMALFORMED").csv(path)
    rows = rows.where(finite(F.col("ts_seconds")) & finite(F.col("price")) & finite(F.col("volume")))
    rows = rows.select((F.round(F.col("ts_seconds") * 1000)).cast("bigint").alias("ts_ms"), "price", "volume")
    if start_ms is not None:
        rows = rows.where(F.col("ts_ms") >= start_ms)
    return rows if end_ms is None else rows.where(F.col("ts_ms") < end_ms)


def series_extent(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """First and last time and the number of rows per series."""
    return rows.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows"))


def close_series(bars: DataFrame, *, seq: str) -> DataFrame:
    """``(symbol, timestamp_ms, close)``, the row of a time that comes last by ``seq`` kept; the scan reads no other columns."""
    rows = bars.select("symbol", "timestamp_ms", F.col("close").cast("double").alias("close"), F.col(seq).alias("_seq"))
    return latest(rows, ["symbol", "timestamp_ms"], [F.col("_seq")]).drop("_seq")


def symbol_scan(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    """The rows of some symbols of a series table (``write_series``): only their partitions are listed and read."""
    return spark.read.parquet(path).where(F.col("symbol").isin(symbols))


def prediction_scan(spark: SparkSession, paths: list[str], *, scenario: str, scope: str = "global") -> DataFrame:
    """Predictions of several files or folders of one schema or a grown one, in order of time, then falling probability, then symbol.

    The filter reaches the scan; in what ``learn.walk_forward`` writes it selects folders. Its ``fold_index`` and ``model_scope`` are
    read under the names that metrics and gates use, ``fold`` and ``scope``.
    """
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    rows = rows.withColumnsRenamed({"fold_index": "fold", "model_scope": "scope"})
    return rows.where((F.col("scenario") == scenario) & (F.col("scope") == scope)).orderBy("timestamp_ms", F.desc("probability"), "symbol")


def selected_external(bars: DataFrame, selection: DataFrame) -> DataFrame:
    """Bars of the venue that a selection table names for each symbol (one row a symbol)."""
    return bars.join(selection, ["symbol", "venue"])


def write_series(bars: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Parquet by symbol, zstd, rows in time order within each file; the commit is atomic. A hot symbol is several files, by month."""
    month = F.date_trunc("month", F.timestamp_millis("timestamp_ms"))
    (
        bars.withColumn("_month", month)
        .repartition("symbol", "_month")
        .sortWithinPartitions("symbol", "timestamp_ms")
        .drop("_month")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("symbol")
        .parquet(path)
    )


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``rows`` holds: a rerun replaces its own rows, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_partitions(spark: SparkSession, incoming: DataFrame, path: str, *, keys: list[str], by: list[str], seq: str, batch: int, listed: int = 1000) -> None:
    """Increment number ``batch`` into a table partitioned by ``by`` (functions of ``keys``): of a key the row of the highest (batch,
    ``seq``) stays. Only partitions that gain a row are read and rewritten; a batch that runs again changes no file.

    Up to ``listed`` partitions are named in the filter of the scan; more are found by a semi-join.
    """
    fresh = latest(incoming, keys, [F.col(seq)]).withColumn("batch", F.lit(batch).cast("bigint"))
    try:
        target = spark.read.parquet(path)
    except AnalysisException:  # the table begins with this increment
        replace_partitions(fresh, path, by)
        return

    def within(rows: DataFrame, of: DataFrame) -> DataFrame:
        parts = of.select(*by).distinct()
        few = parts.limit(listed + 1).collect()
        if len(few) > listed:
            return rows.join(parts, by, "left_semi")
        hit = F.lit(False)
        for p in few:
            hit = hit | reduce(Column.__and__, [F.col(c) == F.lit(p[c]) for c in by])
        return rows.where(hit)

    known = within(target, fresh).select(*keys, F.col("batch").alias("_known"))
    new = staged(fresh.join(known.where(F.col("_known") >= batch), keys, "left_anti"))
    if new.isEmpty():
        return
    both = within(target, new).select(*new.columns).unionByName(new)
    replace_partitions(staged(latest(both, keys, [F.col("batch"), F.col(seq)])), path, by)


def append_log(rows: DataFrame, path: str) -> None:
    """CSV log; doubles with 12 significant digits."""
    text = [twelve_digits(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in rows.dtypes]
    rows.select(*text).write.mode("append").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A result as JSON lines: coverage, weights, selections, metrics or attribution."""
    rows.write.mode("overwrite").json(path)


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Price finite and above 0, volume finite and not negative, time above 0."""
    return ticks.where(finite_positive(F.col("price")) & finite(F.col("volume")) & (F.col("volume") >= 0) & (F.col("ts_ms") > 0))
