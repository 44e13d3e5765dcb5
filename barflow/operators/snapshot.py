"""Labelled training snapshots: cutoff, contiguous-horizon targets, sample weights, row status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_fill, month_key


def closed_cutoff(bars: DataFrame, *, asof_ms: int, interval_ms: int) -> DataFrame:
    """Bars that were closed by ``asof_ms``: labels below its interval's start."""
    return bars.where(F.col("timestamp_ms") < asof_ms // interval_ms * interval_ms)


def universe_reasons(universe: DataFrame, all_bars: DataFrame, closed: DataFrame, excluded: list[str]) -> DataFrame:
    """Expected symbols with the first reason to leave them out, null for those that stay."""
    have = all_bars.select("symbol").distinct().withColumn("have", F.lit(True))
    live = closed.select("symbol").distinct().withColumn("live", F.lit(True))
    reason = (
        F.when(F.col("symbol").isin(excluded), "excluded_symbol")
        .when(F.col("have").isNull(), "missing_dataset_file")
        .when(F.col("live").isNull(), "no_closed_rows_before_asof")
    )
    return universe.join(have, "symbol", "left").join(live, "symbol", "left").select("symbol", reason.alias("reason"))


def horizon_label(bars: DataFrame, *, horizon: int, interval_ms: int, fee: float, combined: bool = True) -> DataFrame:
    """Target close ``horizon`` steps ahead if every step is there, forward return, label and next row's time.

    For distinct, sorted, aligned rows "every step is there" is: the row ``horizon`` rows ahead lies exactly that many
    intervals ahead. One window per symbol; ``horizon`` must be at least 1.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    w = Window.partitionBy("symbol").orderBy("timestamp_ms")
    whole = F.lead("timestamp_ms", horizon).over(w) == F.col("timestamp_ms") + horizon * interval_ms
    target = F.when(whole, F.lead("close", horizon).over(w))
    fill = F.max(is_fill(F.col("source")).cast("int")).over(w.rowsBetween(0, horizon)) == 1
    rows = bars.withColumns({"next_timestamp_ms": F.lead("timestamp_ms").over(w), "next_close": target, "fill_in_horizon": fill})
    ret = F.when(F.col("close") > 0, F.col("next_close") / F.col("close") - 1)
    return rows.withColumn("forward_return", ret).withColumn("y", F.when(F.col("forward_return").isNotNull(), (F.col("forward_return") > 2 * fee).cast("tinyint")))


def with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Native rows weigh 1; synthetic rows take their month's weight. A synthetic row without one makes the job fail."""
    native = F.col("source") == "native"
    w = weights.select("symbol", F.col("month").alias("effective_month"), F.col("weight_final").alias("_w"), F.col("supervised_eligible").alias("_e"))
    joined = rows.withColumn("effective_month", month_key(F.col("timestamp_ms"))).join(w, ["symbol", "effective_month"], "left")
    lacks = F.concat(F.lit("no weight of "), F.col("symbol"), F.lit(" in "), F.col("effective_month"))
    return joined.select(
        *rows.columns,
        "effective_month",
        (native | F.coalesce("_e", F.lit(False))).alias("quality_pass"),
        F.when(native, "native").otherwise("monthly").alias("weight_method_version"),
        F.when(native, 1.0).when(F.col("_w").isNotNull(), F.col("_w")).otherwise(F.raise_error(lacks).cast("double")).alias("effective_monthly_weight"),
    )


def missing_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(symbol, month) of synthetic rows without a weight: what a build would fail on, all at once."""
    wanted = rows.where("source <> 'native'").select("symbol", month_key(F.col("timestamp_ms")).alias("month")).distinct()
    return wanted.join(weights, ["symbol", "month"], "left_anti")


def row_status(horizon: int, combined: bool = True) -> Column:
    """First of: unlabelled, price not positive, gap fill now or in the horizon, synthetic and not eligible, trainable."""
    missing = "unlabeled_missing_next" if horizon == 1 else "unlabeled_missing_horizon"
    out = F.when(F.col("next_close").isNull(), missing).when(F.col("close") <= 0, "invalid_price")
    if combined:
        out = out.when(F.col("fill_in_horizon"), "continuity_only").when((F.col("source") != "native") & ~F.col("quality_pass"), "continuity_only")
    return out.otherwise("trainable")


def build(bars: DataFrame, weights: DataFrame, *, horizon: int, interval_ms: int, fee: float, combined: bool = True) -> DataFrame:
    """The snapshot: labels, weights and status, in the columns ``COLUMNS``; ``supervised_row_weight`` is the weight of trainable
    rows, else 0. Bars without best bid and ask have 0 there; other columns that the bars lack are left out."""
    rows = with_weights(horizon_label(bars, horizon=horizon, interval_ms=interval_ms, fee=fee), weights)
    rows = rows.withColumn("row_status", row_status(horizon, combined))
    rows = rows.withColumns(
        {
            "label_available": F.col("next_close").isNotNull(),
            "supervised_row_weight": F.when(F.col("row_status") == "trainable", F.col("effective_monthly_weight")).otherwise(0.0),
            "interval_seconds": F.lit(interval_ms // 1000),
        }
    )
    quotes = {c: F.col(c) if c in bars.columns else F.lit(0.0) for c in ("inside_bid", "inside_ask")}
    made = rows.withColumns(quotes)
    return made.select(*(c for c in COLUMNS if c in made.columns))


#: The columns of a snapshot row.
COLUMNS = (
    "symbol", "timestamp_ms", "next_timestamp_ms", "interval_seconds", "open", "high", "low", "close", "volume", "inside_bid", "inside_ask", "source", "effective_month", "quality_pass",
    "weight_method_version", "effective_monthly_weight", "supervised_row_weight", "label_available", "row_status", "next_close", "forward_return", "y",
)
#: The status of a snapshot row.
STATUSES = ("trainable", "continuity_only", "unlabeled_missing_next", "unlabeled_missing_horizon", "invalid_price")


def manifest(snapshot: DataFrame) -> DataFrame:
    """Counts, weight sum and extents per symbol and in total (symbol ``*``)."""
    grains = snapshot.withColumn("symbol", F.explode(F.array(F.col("symbol"), F.lit("*"))))
    return grains.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("row_status") == "trainable").alias("trainable_rows"),
        F.count_if(F.col("row_status") == "continuity_only").alias("continuity_rows"),
        F.count_if(F.col("row_status").startswith("unlabeled")).alias("unlabeled_rows"),
        F.count_if(F.col("source") == "native").alias("native_rows"),
        F.round(F.sum("supervised_row_weight"), 6).alias("weight_sum"),
        F.min("timestamp_ms").alias("first_ts"),
        F.max("timestamp_ms").alias("last_ts"),
    )


def parity(bars: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Input rows, output rows and the sum of status buckets, and whether they agree."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    a = bars.agg(F.count(F.lit(1)).alias("input_rows"))
    b = snapshot.agg(F.count(F.lit(1)).alias("output_rows"), F.count_if(F.col("row_status").isin(*STATUSES)).alias("status_rows"))
    same = (F.col("input_rows") == F.col("output_rows")) & (F.col("output_rows") == F.col("status_rows"))
    return one(a).join(one(b), "_one").select("input_rows", "output_rows", "status_rows", same.alias("parity"))


def weight_usage(snapshot: DataFrame) -> DataFrame:
    synthetic = snapshot.where("source <> 'native'")
    return synthetic.groupBy("symbol", "effective_month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("row_status") == "trainable").alias("trainable_rows"),
        F.count_if(F.col("row_status") == "continuity_only").alias("continuity_rows"),
    )


def seal(snapshot: DataFrame, digest: str, path: str, snapshot_id: str | None = None) -> bool:
    """Write once under ``snapshot_id`` (by default the content's digest); false if the same content is there already.

    A folder of that id with other content, or one that was never finished, is an error and stays as it is.
    """
    spark = snapshot.sparkSession
    target = f"{path.rstrip('/')}/{snapshot_id or digest}"
    named = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}" if name else target)
    fs = named("").getFileSystem(spark._jsc.hadoopConfiguration())
    mark = f"_content-{digest}"
    if fs.exists(named("")):
        if not fs.exists(named("_SUCCESS")):
            raise ValueError(f"the snapshot in {target} is incomplete")
        if not fs.exists(named(mark)):
            raise ValueError(f"the snapshot in {target} has other content")
        return False
    fs.create(named(mark)).close()  # before the commit, so that a finished folder always says what it holds
    snapshot.write.mode("append").option("compression", "zstd").partitionBy("symbol").parquet(target)
    return True
