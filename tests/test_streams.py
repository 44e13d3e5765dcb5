from pyspark.sql import functions as F

from barflow.plans import data, streams
from barflow.streaming import jobs as M

SF = "/root/testdata/sf0.001"


def test_stream_bars_agree_with_batch(spark):
    batch = {(r.symbol, r.timestamp_ms): (r.open, r.high, r.low, r.close, r.volume) for r in data.tick_bars(spark, SF).collect()}
    stream = {(r.symbol, r.timestamp_ms): (r.open, r.high, r.low, r.close, r.volume) for r in streams.stream_bars(spark, SF).collect()}
    assert len(stream) >= 0.95 * len(batch) and all(batch.get(k, v) == v for k, v in stream.items())


def test_late_repair_equals_batch(spark):
    want = sorted(map(tuple, data.tick_bars(spark, SF).select("symbol", "timestamp_ms", "close").collect()))
    assert sorted(map(tuple, streams.stream_late_repair(spark, SF).select("symbol", "timestamp_ms", "close").collect())) == want


def test_stream_dedup_and_sink(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 5), ("A", 1, 5), ("B", 2, 6)], "symbol string, seq int, v int")
    assert M.deduplicated(df).count() == 2
    sink = M.idempotent_sink(str(tmp_path / "s"), ["symbol", "seq"], "v")
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_incremental_indicators_equal_batch(spark, tmp_path):
    from barflow.operators import signals as K

    bars = data.tick_bars(spark, SF).select("symbol", "timestamp_ms", "high", "low", "close")
    bars.orderBy("timestamp_ms").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
    with M.rocksdb_state(spark):
        out = streams.finished(spark, M.incremental_indicators(live, fast=12, slow=26, atr=14))
    want = {(r.symbol, r.timestamp_ms): (r.ema_fast, r.ema_slow, r.atr) for r in K.indicators(bars, fast=12, slow=26, atr=14).collect()}
    got = {(r.symbol, r.timestamp_ms): (r.ema_fast, r.ema_slow, r.atr) for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-6 for k in got for a, b in zip(got[k], want[k], strict=True))


def test_monitor_and_sessions_run_on_tables_too(spark):
    bars = data.tick_bars(spark, SF)
    assert M.coverage_monitor(bars).where(F.col("coverage") > 1).count() == 0
    assert streams.stream_sessions(spark, SF).count() > 0


def test_indicators_restart_from_their_checkpoint(spark, tmp_path):
    """A query that is stopped and started again goes on from its state; repeated and late bars are passed over."""
    from barflow.operators import signals as K

    rows = [("A", t, 10.0 + t % 7, 9.0 - t % 3, 9.5 + t % 5) for t in range(1, 41)]
    kind = "symbol string, timestamp_ms bigint, high double, low double, close double"
    for part in (rows[:17], rows[10:33], rows[33:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        with M.rocksdb_state(spark):
            q = M.incremental_indicators(live, fast=3, slow=8, atr=5).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log"))
            q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    want = {r.timestamp_ms: (r.ema_fast, r.ema_slow, r.atr) for r in K.indicators(spark.createDataFrame(rows, kind), fast=3, slow=8, atr=5).collect()}
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 40 and all(abs(x - y) < 1e-9 for r in out for x, y in zip((r.ema_fast, r.ema_slow, r.atr), want[r.timestamp_ms], strict=True))
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_late_ticks_touch_their_bars_alone(spark, tmp_path):
    """Golden: ticks behind the last closed bar go to a side table; their bars are built again, files of other days stay."""
    from barflow.operators import bars as B

    hour, day = 3_600_000, 86_400_000
    t0 = 20_000 * day
    tick = "symbol string, ts_ms bigint, price double, volume double, seq bigint"
    sink = M.late_bars_sink(str(tmp_path), lambda t: B.ohlcv_bars(t, interval_ms=hour, start_ms=t0, end_ms=t0 + 30 * day), interval_ms=hour, delay_ms=hour)
    first = [("A", t0 + k * hour + 5, 10.0 + k, 1.0, k) for k in range(60)]
    sink(spark.createDataFrame(first, tick), 0)
    read = lambda: {(r.symbol, r.timestamp_ms): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "bars").rglob("*.parquet")}
    before, old = read(), files()
    assert len(before) == 58  # the last two hours are open
    late = [("A", t0 + 30 * hour + 9, 99.0, 2.0, 100), ("B", t0 + 30 * hour + 9, 7.0, 1.0, 101)]
    batch = spark.createDataFrame(late, tick)
    sink(batch, 1)
    after, new = read(), files()
    label = t0 + 31 * hour
    assert after == before | {("A", label): (40.0, 99.0, 40.0, 99.0, 3.0), ("B", label): (7.0, 7.0, 7.0, 7.0, 1.0)}
    assert {f for f in old if new.get(f) != old[f]} == {f for f in old if "day=2024-10-05" in f} and spark.read.parquet(str(tmp_path / "late")).count() == 2
    sink(batch, 1)  # again: nothing changes
    assert read() == after and files() == new
    sink(spark.createDataFrame([("A", t0 + 60 * hour + 5, 1.0, 1.0, 200)], tick), 2)
    assert len(read()) == len(after) + 1


def test_late_bars_of_a_stream_equal_batch(spark):
    want = {(r.symbol, r.timestamp_ms): (r.open, r.high, r.low, r.close) for r in data.tick_bars(spark, SF).collect()}
    got = {(r.symbol, r.timestamp_ms): (r.open, r.high, r.low, r.close) for r in streams.stream_late_bars(spark, SF).collect()}
    assert len(got) >= 0.95 * len(want) and all(want[k] == v for k, v in got.items())
