import random

from pyspark.sql import functions as F

from barflow.operators import ledger as L
from barflow.operators import signals as K
from barflow.operators.recurrence import ema, linear_recurrence


def test_ema_golden(spark):
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate((1, 2, 3))], "symbol string, timestamp_ms bigint, close double")
    out = [r.e for r in ema(df, ["symbol"], ["timestamp_ms"], "close", 2, "e").orderBy("timestamp_ms").collect()]
    assert [round(x, 6) for x in out] == [1.0, 1.666667, 2.555556]


def test_atr_golden(spark):
    rows = [("A", i, float(h), float(lo), float(c)) for i, (h, lo, c) in enumerate(zip((10, 12, 14), (8, 10, 12), (9, 11, 13), strict=True))]
    df = spark.createDataFrame(rows, "symbol string, timestamp_ms bigint, high double, low double, close double")
    out = K.wilder(K.true_range(df), ["symbol"], ["timestamp_ms"], "tr", 2, "atr").orderBy("timestamp_ms").collect()
    assert [r.atr for r in out] == [2.0, 2.5, 2.75]


def test_recurrence_across_chunks(spark):
    r = random.Random(5)
    rows = [(k, i, r.random(), r.uniform(-1, 1)) for k in "xy" for i in range(157)]
    df = spark.createDataFrame(rows, "k string, t int, a double, b double").repartition(5)
    got = {(x.k, x.t): x.y for x in linear_recurrence(df, ["k"], ["t"], F.col("a"), F.col("b"), "y", y0=2.0, chunk=10).collect()}
    for k in "xy":
        y = 2.0
        for _, t, a, b in (x for x in rows if x[0] == k):
            y = a * y + b
            assert abs(got[(k, t)] - y) < 1e-9


def replay(spark, fills):
    df = spark.createDataFrame([("A", i, *f, 0) for i, f in enumerate(fills)], "symbol string, seq int, side string, qty double, price double, fee double, filled_ms bigint")
    return L.position_replay(df).orderBy("seq").collect()


def test_ledger_goldens(spark):
    a = replay(spark, [("buy", 1.0, 100.0, 0.0), ("buy", 1.0, 120.0, 1.2)])[-1]
    assert (a.position_qty, round(a.avg_entry_price, 6), round(a.cash_delta, 6)) == (2.0, 110.6, -121.2)
    b = replay(spark, [("buy", 2.0, 100.0, 0.0), ("sell", 1.0, 110.0, 0.44)])[-1]
    assert (round(b.realized_pnl, 6), round(b.cash_delta, 6)) == (9.56, 109.56)
    c = replay(spark, [("buy", 1.0, 100.0, 0.0), ("sell", 1.0, 90.0, 0.36)])[-1]
    assert (round(c.realized_pnl, 6), c.position_qty, c.avg_entry_price) == (-10.36, 0.0, 0.0)


def test_violations(spark):
    df = spark.createDataFrame([("A", 1, "sell", 1.0, 5.0, 0.0), ("A", 2, "buy", -1.0, 0.0, -1.0)], "symbol string, seq int, side string, qty double, price double, fee double")
    found = {(r.seq, r.violation) for r in L.fill_violations(df, cash=100.0).collect()}
    assert {(1, "oversell"), (2, "quantity"), (2, "price"), (2, "fee")} <= found


def test_entry_and_exit_reasons(spark):
    s = spark.createDataFrame(
        [("a", 1, 9.0, 11.0, 10.0, 1.0), ("b", 1, 12.0, 11.0, 10.0, 1.0), ("c", 1, 9.0, 9.0, 10.0, 1.0), ("d", 1, None, None, None, None), ("e", 1, 9.0, 11.0, 10.0, 1.0), ("f", 1, 9.0, 11.0, 10.0, 1.0)],
        "symbol string, timestamp_ms bigint, close double, ema_fast double, ema_slow double, atr double",
    )
    p = spark.createDataFrame([("e", 1.0, 20.0, 0, None), ("f", 0.0, 0.0, None, 995)], "symbol string, qty double, avg_entry_price double, entry_ms bigint, last_exit_ms bigint")
    entry = {r.symbol: r.reason for r in K.entry_signals(s, p, now_ms=1000, cooldown_ms=10).collect()}
    assert entry == {"a": "entry_conditions_met", "b": "no_pullback", "c": "trend_not_up", "d": "insufficient_data", "e": "position_open", "f": "cooldown_active"}
    leave = {r.symbol: r.reason for r in K.exit_signals(s, p, now_ms=1000, stop_k=2.0, max_hold_ms=10).collect()}
    assert leave["e"] == "atr_stop" and leave["a"] == "no_position" and leave["d"] == "insufficient_data"
