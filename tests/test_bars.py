import random

from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.operators import quality as Q
from barflow.sources import tables as A

I, DAY = 900_000, 86_400_000
T0 = 1_767_225_600_000  # 2026-01-01


def series(spark, n=288, skip=(), symbol="A"):
    rows = [(symbol, T0 + i * I, 100 + 0.1 * i, 100.5 + 0.1 * i, 99.5 + 0.1 * i, 100.2 + 0.1 * i, 10.0 + i, "native") for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "symbol string, timestamp_ms bigint, open double, high double, low double, close double, volume double, source string")


def test_gap_repair_fills_between_bars_only(spark):
    out = B.repair_gaps(series(spark, skip=(0, 10, 11, 12, 287)), interval_ms=I, source="ext_b_fill")
    fills = out.where("source = 'ext_b_fill'").orderBy("timestamp_ms").collect()
    assert out.count() == 286 and [r.volume for r in fills] == [0.0] * 3
    assert {r.close for r in fills} == {100.2 + 0.1 * 9}
    assert Q.gap_count(out, interval_ms=I).first().gap_count == 0


def test_gap_count(spark):
    assert Q.gap_count(series(spark, skip=(10,)), interval_ms=I).first().gap_count == 1


def test_ticks_to_bars_boundary_belongs_to_next_label(spark):
    ticks = [("A", T0 + k * I + 60_000, 100.0 + k, 1.0, k) for k in range(192)]
    random.Random(1).shuffle(ticks)
    df = spark.createDataFrame(ticks, "symbol string, ts_ms bigint, price double, volume double, seq bigint")
    assert B.ohlcv_bars(df, interval_ms=I, start_ms=T0, end_ms=T0 + 2 * DAY).count() == 191
    edge = spark.createDataFrame([("A", T0 + I, 5.0, 1.0, 1), ("A", T0 + I, float("nan"), 1.0, 2), ("A", T0 + I, 6.0, -1.0, 3)], df.schema)
    row = B.ohlcv_bars(edge, interval_ms=I, start_ms=T0, end_ms=T0 + DAY).first()
    assert (row.timestamp_ms, row.open, row.volume) == (T0 + 2 * I, 5.0, 1.0)


def test_open_and_close_follow_time_then_seq(spark):
    rows = [("A", T0 + 5, 2.0, 1.0, 2), ("A", T0 + 5, 1.0, 1.0, 1), ("A", T0 + 9, 7.0, 1.0, 3)]
    df = spark.createDataFrame(rows, "symbol string, ts_ms bigint, price double, volume double, seq bigint")
    row = B.ohlcv_bars(df, interval_ms=I, start_ms=T0, end_ms=T0 + DAY).first()
    assert (row.open, row.high, row.low, row.close) == (1.0, 7.0, 1.0, 7.0)


def test_normalizers_drop_short_and_non_finite(spark):
    rows = [("A", [T0 + 5.0, 12.0, 9.0, 10.0, 11.0, 3.0]), ("A", [T0 + 5.0, 1.0]), ("A", [T0 + 5.0, float("inf"), 9.0, 10.0, 11.0, 3.0]), ("A", None)]
    df = spark.createDataFrame(rows, "symbol string, candle array<double>")
    native = B.normalize_native(df, interval_ms=I).collect()
    assert [(r.timestamp_ms, r.open, r.high, r.low, r.close, r.inside_bid) for r in native] == [(T0, 10.0, 12.0, 9.0, 11.0, 0.0)]
    opened = B.normalize_open_labelled(df, interval_ms=I).collect()
    assert [(r.timestamp_ms, r.open) for r in opened] == [(T0 + I, 12.0)]


def test_normalizers_build_a_candle_once(spark):
    """However the arrays are built, a row's is built once, not for every field that is tested."""
    rows = spark.range(5).select(F.lit("A").alias("symbol"), F.concat(F.array(F.lit(T0 + 5.0), F.col("id") + 1.0, F.lit(9.0), F.lit(10.0), F.lit(11.0)), F.array(F.lit(3.0))).alias("candle"))
    for df in (B.normalize_native(rows, interval_ms=I), B.normalize_open_labelled(rows, interval_ms=I)):
        assert df._jdf.queryExecution().executedPlan().toString().count("concat(") == 1
        assert df.count() == 5


def test_merge_is_idempotent(spark):
    base = series(spark).withColumn("seq", F.lit(0))
    again = base.withColumns({"close": F.col("close") + 1, "seq": F.lit(1)})
    merge = lambda a, b: A.merge_upsert(a, b, ["symbol", "timestamp_ms"], "timestamp_ms", T0, T0 + DAY, "seq")
    once = merge(base, again)
    assert once.count() == 288 and sorted(once.collect()) == sorted(merge(once, again).collect())


def test_lenient_scan_defaults(spark):
    raw = spark.createDataFrame([(None, "1000", None, 1), ("a ", "bad", 2.0, 2), ("a", "1000", 3.0, 3), ("a", "1000", 4.0, 4)], "symbol string, timestamp_ms string, close double, seq int")
    rows = {r.symbol: r for r in A.lenient_scan(raw, interval_ms=I, symbol="fb", source="native").collect()}
    assert set(rows) == {"FB", "A"} and rows["A"].close == 4.0 and rows["FB"].close == 0.0 and rows["A"].source == "native"


def test_missing_windows_split_long_runs(spark):
    have = series(spark, n=96 * 10, skip=set(range(96 * 1 + 3, 96 * 8)))
    out = Q.missing_windows(have, start_ms=T0, end_ms=T0 + 10 * DAY, interval_ms=I, max_days=3).orderBy("from_day").collect()
    d = T0 // DAY
    assert [(r.from_day - d, r.to_day - d, r.days) for r in out] == [(1, 3, 3), (4, 6, 3), (7, 7, 1)]


def test_content_hash_ignores_partitioning(spark):
    cols = ("symbol", "timestamp_ms", "open", "close", "source")
    a = Q.content_hash(series(spark), cols).first()
    b = Q.content_hash(series(spark).repartition(7, "close"), cols).first()
    c = Q.content_hash(series(spark, skip=(5,)), cols).first()
    assert a == b and a.content_hash != c.content_hash


def test_series_sink_and_csv_log(spark, tmp_path):
    A.write_series(series(spark), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 288
    A.append_log(spark.createDataFrame([(0.1 + 0.2, "x"), (1e20, "y"), (5.0, "z")], "v double, k string"), str(tmp_path / "log"))
    rows = {r.k: r.v for r in spark.read.csv(str(tmp_path / "log"), header=True).collect()}
    assert rows["x"] == "0.3" and rows["z"] == "5" and float(rows["y"]) == 1e20


def test_replace_partitions_keeps_others(spark, tmp_path):
    p = str(tmp_path / "m")
    A.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, run string"), p, ["run"])
    A.replace_partitions(spark.createDataFrame([(3, "b")], "v int, run string"), p, ["run"])
    assert sorted((r.v, r.run) for r in spark.read.parquet(p).collect()) == [(1, "a"), (3, "b")]
