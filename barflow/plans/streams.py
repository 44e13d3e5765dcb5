"""The streaming jobs run to the end over the event table; their results are tables like any other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import fixtures as X
from ..sources.staging import stage_folder
from ..streaming import jobs as M
from . import query


def streamed(spark, sf) -> DataFrame:
    """The event table as a stream of files; ticks in its order."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    ticks = events.selectExpr(
        "event_type as symbol", "unix_millis(cast(ts as timestamp)) as ts_ms", "value as price", "cast(get_json_object(props, '$.k') as double) as volume", "event_id as seq"
    ).where("price > 0")
    return M.with_event_time(ticks)


def finished(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query to the end of its input into files of the shared folder, and read them."""
    folder = stage_folder(spark)
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query()
def stream_bars(spark, sf):
    """Closed hourly bars; windows still open at the end of input stay behind the watermark."""
    return finished(spark, M.stream_bars(streamed(spark, sf), interval="1 hour"))


@query()
def stream_dedup(spark, sf):
    return finished(spark, M.deduplicated(streamed(spark, sf), delay="40 days")).select("symbol", "seq", "ts_ms")


@query()
def stream_sessions(spark, sf):
    return finished(spark, M.activity_sessions(streamed(spark, sf).drop("event_time")))


@query()
def stream_late_repair(spark, sf):
    """Bars of the stream with those after its last closed window rebuilt from the table: equal to the batch bars."""
    ticks = X.ticks(spark, sf)
    bars = finished(spark, M.stream_bars(streamed(spark, sf), interval="1 hour"))
    last = bars.agg(F.max("timestamp_ms")).first()[0] or X.TICKS_FROM
    return M.late_repair(ticks, bars, lambda t: B.ohlcv_bars(t, interval_ms=X.HOUR, start_ms=X.TICKS_FROM, end_ms=X.TICKS_TO), since_ms=last)


def bar_stream(spark, sf) -> DataFrame:
    """The batch bars as a stream of files, in time order."""
    from . import data

    folder = stage_folder(spark)
    bars = data.tick_bars(spark, sf).select("symbol", "timestamp_ms", "high", "low", "close")
    bars.orderBy("timestamp_ms").write.parquet(folder)
    return spark.readStream.schema(bars.schema).parquet(folder)


@query()
def stream_coverage(spark, sf):
    """Expected bars present in each day-long window, every hour, once the window is closed."""
    return finished(spark, M.coverage_monitor(bar_stream(spark, sf)))


@query()
def stream_indicators(spark, sf):
    with M.rocksdb_state(spark):
        return finished(spark, M.incremental_indicators(bar_stream(spark, sf), fast=12, slow=26, atr=14))


@query()
def stream_late_bars(spark, sf):
    """Hourly bars of ticks that arrive in many batches, every seventh a day late: equal to the batch bars that are closed."""
    ticks = X.ticks(spark, sf).where((F.col("ts_ms") >= X.TICKS_FROM) & (F.col("ts_ms") < X.TICKS_TO))
    arrives = F.col("ts_ms") + F.when(F.col("seq") % 7 == 0, X.DAY).otherwise(0)
    folder, incoming = stage_folder(spark), stage_folder(spark)
    ticks.repartitionByRange(12, arrives).write.parquet(incoming)
    live = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 3).parquet(incoming)
    build = lambda t: B.ohlcv_bars(t, interval_ms=X.HOUR, start_ms=X.TICKS_FROM, end_ms=X.TICKS_TO)
    sink = M.late_bars_sink(folder, build, interval_ms=X.HOUR, delay_ms=X.HOUR)
    live.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    bars = spark.read.parquet(f"{folder}/bars")
    return bars.drop("day", "version", "batch")
