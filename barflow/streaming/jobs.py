"""Structured Streaming jobs: ticks to closed bars, de-duplication, late data, incremental indicators, monitors, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import latest, replace_partitions, upsert_partitions, valid_ticks

INDICATORS = "symbol string, timestamp_ms bigint, close double, ema_fast double, ema_slow double, atr double"
STATE = "last_ms bigint, close double, ema_fast double, ema_slow double, atr double"
NAMES = ("last_ms", "close", "ema_fast", "ema_slow", "atr")


def deduplicated(ticks: DataFrame, *, event_time: str = "event_time", delay: str = "1 day") -> DataFrame:
    """Ticks with unseen ``seq``; on a stream within the watermark, on a table overall."""
    if ticks.isStreaming:
        return ticks.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["symbol", "seq"])
    return ticks.dropDuplicates(["symbol", "seq"])


def stream_bars(ticks: DataFrame, *, interval: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Closed bars of a tick stream (append mode emits a bar once its window is behind the watermark).

    ``ticks`` has an ``event_time`` timestamp next to the tick columns. A window's end is the bar's label, so a tick on a
    boundary belongs to the next bar, as in the batch operator.
    """
    at = F.struct("ts_ms", "seq")
    windowed = valid_ticks(ticks).withWatermark("event_time", delay).groupBy("symbol", F.window("event_time", interval))
    bars = windowed.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select("symbol", F.unix_millis("window.end").alias("timestamp_ms"), "open", "high", "low", "close", "volume")


def with_event_time(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("event_time", F.timestamp_millis("ts_ms"))


def coverage_monitor(bars: DataFrame, *, window: str = "1 day", slide: str = "1 hour", expected: int = 24, delay: str = "1 hour") -> DataFrame:
    """Share of expected bars in each sliding window per symbol."""
    w = bars.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay).groupBy("symbol", F.window("event_time", window, slide))
    return w.agg(F.count(F.lit(1)).alias("bars")).select("symbol", F.unix_millis("window.start").alias("from_ms"), "bars", (F.col("bars") / expected).alias("coverage"))


def activity_sessions(ticks: DataFrame, *, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Stretches of activity between outages of at least ``gap``."""
    s = with_event_time(ticks).withWatermark("event_time", delay).groupBy("symbol", F.session_window("event_time", gap))
    return s.agg(F.count(F.lit(1)).alias("ticks")).select("symbol", F.unix_millis("session_window.start").alias("from_ms"), F.unix_millis("session_window.end").alias("to_ms"), "ticks")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Within, streaming queries that start keep their state in RocksDB, as ``transformWithState`` needs; the setting then comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class IndicatorState(StatefulProcessor):
    """EMA and ATR of one symbol: the last bar's values are a state variable, a batch's bars are folded at once."""

    def __init__(self, fast: int, slow: int, atr: int, ttl_ms: int | None):
        self.alphas = {"ema_fast": 2 / (fast + 1), "ema_slow": 2 / (slow + 1), "atr": 1 / atr}
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bars = pd.concat(list(rows)).sort_values("timestamp_ms", kind="stable").drop_duplicates("timestamp_ms")
        state = dict(zip(NAMES, self.last.get(), strict=True)) if self.last.exists() else None
        if state is not None:
            bars = bars[bars.timestamp_ms > state["last_ms"]]
        if not len(bars):
            return
        before = bars.close.shift(fill_value=state["close"] if state else float("nan"))
        reach = pd.concat([bars.high - bars.low, (bars.high - before).abs(), (bars.low - before).abs()], axis=1).max(axis=1)  # passes over missing ones
        out = pd.DataFrame({"symbol": key[0], "timestamp_ms": bars.timestamp_ms, "close": bars.close})
        for name, alpha in self.alphas.items():
            values = reach if name == "atr" else bars.close
            seeded = pd.concat([pd.Series([state[name]]), values]) if state else values
            out[name] = seeded.ewm(alpha=alpha, adjust=False).mean().to_numpy()[-len(bars) :]
        end = out.iloc[-1]
        self.last.update((int(end.timestamp_ms), *(float(end[c]) for c in NAMES[1:])))
        yield out

    def close(self) -> None:
        pass


def incremental_indicators(bars: DataFrame, *, fast: int, slow: int, atr: int, ttl_ms: int | None = None) -> DataFrame:
    """EMA and ATR per symbol carried in a state variable; bars not after the last one are skipped, of equal times the first counts.

    Late bars are for the batch operators: a recurrence can't take them back. With ``ttl_ms`` the state of a symbol without bars for
    so long (processing time) goes, and the symbol begins anew. The query has to start within ``rocksdb_state``, or in a session
    whose state store is RocksDB.
    """
    processor = IndicatorState(fast, slow, atr, ttl_ms)
    return bars.groupBy("symbol").transformWithStateInPandas(
        processor, outputStructType=INDICATORS, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime"
    )


def idempotent_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: one row per key, partitions of the batch overwritten, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(latest(batch, keys, [F.col(order)]), path, ["symbol"])

    return write


def late_bars_sink(folder: str, rebuild: Callable[[DataFrame], DataFrame], *, interval_ms: int, delay_ms: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: bars of a tick stream, right also where ticks come after their bar was closed.

    Bars are closed up to the greatest time of earlier batches less ``delay_ms``. Ticks of a batch behind that go to a side table
    as well; the bars that they touch, and no others, are built again from all their ticks and upserted. Other bars are built
    once, when they close. ``rebuild`` makes bars of ticks (``symbol``, ``ts_ms``); a bar is labelled by its end.

    Tables under ``folder``: ``ticks`` and ``late`` by batch, ``marks`` (what was closed before each batch), ``bars`` by day and symbol.
    Every batch overwrites its own partitions, and upserts are numbered by batch, so a batch that runs again changes nothing.
    """
    end = (F.floor(F.col("ts_ms") / interval_ms) + 1) * interval_ms

    def marks(spark: SparkSession, batch_id: int) -> tuple[int | None, int | None]:
        """Closed before the batch, and the greatest time seen."""
        try:
            row = spark.read.parquet(f"{folder}/marks").where(F.col("batch") < batch_id).agg(F.max("seen_ms").alias("s"), F.max("closed_ms").alias("c")).first()
            return row["c"], row["s"]
        except AnalysisException:
            return None, None

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        replace_partitions(batch.withColumn("batch", F.lit(batch_id)), f"{folder}/ticks", ["batch"])
        ticks = spark.read.parquet(f"{folder}/ticks").where(F.col("batch") <= batch_id)
        own = ticks.where(F.col("batch") == batch_id)
        closed, seen = marks(spark, batch_id)
        top = own.agg(F.max("ts_ms")).first()[0]
        seen = max(x for x in (seen, top) if x is not None) if (seen, top) != (None, None) else None
        now = closed if seen is None else max(closed or -(1 << 62), (seen - delay_ms) // interval_ms * interval_ms)
        touched = own.where(F.lit(False)).select("symbol", end.alias("timestamp_ms"))
        if closed is not None:
            late = own.where(end <= closed)
            replace_partitions(late, f"{folder}/late", ["batch"])
            touched = late.select("symbol", end.alias("timestamp_ms")).distinct()
        # Only the ticks of these bars are aggregated.
        of_late = ticks.withColumn("_end", end).join(touched.withColumnRenamed("timestamp_ms", "_end"), ["symbol", "_end"], "left_semi").drop("_end")
        if now is not None:
            closing = ticks.where((end <= now) & ((F.lit(closed is None)) | (end > (closed or 0))))
            bars = rebuild(of_late.unionByName(closing).drop("batch"))
            bars = bars.withColumns({"day": F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd"), "version": F.lit(batch_id)})
            upsert_partitions(spark, bars, f"{folder}/bars", keys=["symbol", "timestamp_ms"], by=["day", "symbol"], seq="version", batch=batch_id)
        mark = spark.range(1).select(F.lit(seen).cast("bigint").alias("seen_ms"), F.lit(now).cast("bigint").alias("closed_ms"), F.lit(batch_id).alias("batch"))
        replace_partitions(mark, f"{folder}/marks", ["batch"])

    return write


def late_repair(ticks: DataFrame, bars: DataFrame, rebuild: Callable[[DataFrame], DataFrame], *, since_ms: int) -> DataFrame:
    """Bars after ticks have come in too late for the stream: affected bars are aggregated again from all ticks and replace theirs."""
    fresh = rebuild(ticks.where(F.col("ts_ms") >= since_ms)).withColumn("_version", F.lit(1))
    return latest(bars.withColumn("_version", F.lit(0)).unionByName(fresh), ["symbol", "timestamp_ms"], [F.col("_version")]).drop("_version")
