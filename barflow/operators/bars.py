"""Ticks to bars, candle normalisation, grids and gap repair. A bar is labelled by its close time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, finite_positive
from ..sources.tables import valid_ticks


def bar_label(ts: Column, interval_ms: int) -> Column:
    """The close of the bar that a tick belongs to; a tick on a boundary belongs to the next bar."""
    return ((F.floor(ts / interval_ms) + 1) * interval_ms).cast("bigint")


def ohlcv_bars(ticks: DataFrame, *, interval_ms: int, start_ms: int, end_ms: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Open, high, low, close and volume per bar; first and last by (time, seq), not by arrival.

    Ticks and labels both lie in [start, end). Invalid ticks are dropped. Partial aggregates meet per (key, bar): a hot
    symbol is as many groups as it has bars.
    """
    inside = valid_ticks(ticks).where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    labelled = inside.withColumn("timestamp_ms", bar_label(F.col("ts_ms"), interval_ms)).where(F.col("timestamp_ms") < end_ms)
    at = F.struct("ts_ms", "seq")
    return labelled.groupBy(*keys, "timestamp_ms").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
    )


def _candles(rows: DataFrame, fields: dict[str, int], interval_ms: int, shift: int) -> DataFrame:
    get = lambda i: F.try_element_at("candle", F.lit(i))
    ts = (F.floor(get(1) / interval_ms) * interval_ms).cast("bigint") + shift
    ok = finite(get(1)) & (get(1) > 0) & (F.size("candle") >= 6)
    for i in fields.values():
        if 0 < i <= 6:
            ok = ok & finite(get(i))
    values = {n: F.coalesce(get(i), F.lit(0.0)) if i > 0 else F.lit(0.0) for n, i in fields.items()}
    # Exploded, since a filter on the arrays would be pushed below what builds them and build them anew for each field it tests.
    made = F.explode(F.array(F.when(ok, F.struct("symbol", ts.alias("timestamp_ms"), *(v.alias(n) for n, v in values.items())))))
    return rows.select(made.alias("bar")).where("bar is not null").select("bar.*")


def normalize_native(rows: DataFrame, *, interval_ms: int) -> DataFrame:
    """``candle`` arrays in the order time, high, low, open, close, volume[, bid, ask]; times are floored to the interval.

    Arrays below six fields, non-finite fields and times <= 0 are dropped; missing bid and ask are 0.
    """
    order = {"open": 4, "high": 2, "low": 3, "close": 5, "volume": 6, "inside_bid": 7, "inside_ask": 8}
    return _candles(rows, order, interval_ms, 0)


def normalize_open_labelled(rows: DataFrame, *, interval_ms: int) -> DataFrame:
    """``candle`` arrays in the order open time, open, high, low, close, volume; labels move to the close; bid and ask are 0."""
    order = {"open": 2, "high": 3, "low": 4, "close": 5, "volume": 6, "inside_bid": 0, "inside_ask": 0}
    return _candles(rows, order, interval_ms, interval_ms)


def roll_up(bars: DataFrame, *, interval_ms: int) -> DataFrame:
    """Bars of a coarser interval; a bar labelled on a coarse boundary closes that coarse bar."""
    label = (F.ceil(F.col("timestamp_ms") / interval_ms) * interval_ms).cast("bigint")
    return bars.groupBy("symbol", label.alias("label")).agg(
        F.min_by("open", "timestamp_ms").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "timestamp_ms").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bars"),
    ).withColumnRenamed("label", "timestamp_ms")


def time_grid(spark: SparkSession, *, start_ms: int, end_ms: int, interval_ms: int) -> DataFrame:
    """Expected times in [start, end)."""
    return spark.range(start_ms, end_ms, interval_ms).withColumnRenamed("id", "timestamp_ms")


def repair_gaps(bars: DataFrame, *, interval_ms: int, source: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Flat bars between consecutive bars further apart than one step: previous close, volume 0, ``source`` as tag.

    Nothing before the first or after the last bar; nothing where the previous close is not finite and above 0.
    """
    inside = bars if start_ms is None else bars.where((F.col("timestamp_ms") >= start_ms) & (F.col("timestamp_ms") < end_ms))
    w = Window.partitionBy("symbol").orderBy("timestamp_ms")
    gaps = inside.select("symbol", "timestamp_ms", "close", F.lead("timestamp_ms").over(w).alias("next"))
    gaps = gaps.where((F.col("next") - F.col("timestamp_ms") > interval_ms) & finite_positive(F.col("close")))
    step = F.lit(interval_ms).cast("bigint")
    times = F.explode(F.sequence(F.col("timestamp_ms") + step, F.col("next") - 1, step))
    flat = gaps.select("symbol", times.alias("timestamp_ms"), *(F.col("close").alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume"), F.lit(source).alias("source"))
    return bars.unionByName(flat)


def latest_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("timestamp_ms").alias("timestamp_ms"), F.max_by("close", "timestamp_ms").alias("close"))
