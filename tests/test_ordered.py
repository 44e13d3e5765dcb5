import random
import statistics

import pytest
from pyspark.sql import functions as F

from barflow.operators import ledger as L
from barflow.operators import trades as J
from barflow.operators.normalize import robust_median
from barflow.operators.ordered import order_statistics, prefix_sums
from barflow.operators.recurrence import linear_recurrences

DAY = 86_400_000


def test_prefix_sums(spark):
    r = random.Random(1)
    rows = [(k, t, r.randrange(-5, 9)) for k in "ab" for t in r.sample(range(3000), 400)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    cells = [F.floor(F.col("t") / 512).cast("bigint"), F.floor(F.col("t") / 16).cast("bigint")]
    got = {(x.k, x.t): (x.s, x.n) for x in prefix_sums(df, ["k"], cells, ["t"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    assert got == {(k, t): (sum(v for q, u, v in rows if q == k and u < t), sum(q == k and u < t for q, u, _ in rows)) for k, t, _ in rows}


def test_order_statistics_of_every_sign(spark):
    r = random.Random(2)
    values = [r.choice([1, -1]) * 10 ** r.uniform(-300, 300) for _ in range(60)] + [0.0, -0.0, float("inf"), float("-inf"), 5e-324] + [1 + k * 1e-9 for k in range(40)] + [1.0] * 9 + [None] * 3
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(3)
    want = sorted(v for v in values if v is not None)
    got = {x.which: x.v for x in order_statistics(df, ["k"], "v", lambda n: [F.lit(i) for i in range(len(want))]).collect()}
    assert [got[i] for i in range(len(want))] == want


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 20, 61, 400])
def test_trimmed_median_equals_a_sort(spark, n):
    r = random.Random(n)
    values = [r.choice([r.gauss(1, 1e-7), r.gauss(1, 0.3), 1.0, 1e6]) for _ in range(n)]
    x = sorted(values)
    lo = int(n * 0.05)
    part = x if n < 8 else x[lo : max(lo + 1, int(n * 0.95))]
    got = robust_median(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v").first()
    assert got.value == pytest.approx(statistics.median(part), rel=1e-15) and got.value_rows == n


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_holds_a_whole_key(spark):
    """Every window is partitioned by a cell too."""
    fills = spark.createDataFrame([], "symbol string, seq bigint, side string, qty double, price double, fee double, filled_ms bigint")
    for df in (L.position_replay(fills), L.fill_violations(fills, cash=1.0), L.position_times(fills), robust_median(fills, ["symbol"], "price")):
        windows = [line for line in plan(df).splitlines() if "Window [" in line]
        assert windows and not any(w.rstrip().endswith("], [symbol#" + w.rsplit("[symbol#", 1)[-1].split("]")[0] + "], []") for w in windows)


def test_replay_of_one_symbol_over_many_cells(spark):
    """Positions, costs and flat marks against a loop."""
    r = random.Random(4)
    fills, q = [], 0
    for seq in range(3000):
        side = "buy" if q == 0 or r.random() < 0.5 else "sell"
        qty = r.randrange(1, 5) if side == "buy" else (q if r.random() < 0.3 else r.randrange(1, q + 1))
        q += qty if side == "buy" else -qty
        fills.append(("S", seq, side, float(qty), float(r.randrange(50, 150)), 0.25, 1000 + seq))
    df = spark.createDataFrame(fills, "symbol string, seq bigint, side string, qty double, price double, fee double, filled_ms bigint").repartition(7)
    got = {x.seq: (x.position_qty, x.avg_entry_price, x.realized_pnl) for x in L.position_replay(df).collect()}
    q = cost = 0.0
    entry = last = None
    for _, seq, side, qty, price, fee, at in fills:
        if side == "buy":
            entry = at if q == 0 else entry
            q, cost, pnl = q + qty, cost + qty * price + fee, 0.0
        else:
            pnl = qty * price - fee - cost / q * qty
            cost, q = (0.0 if q == qty else cost * (1 - qty / q)), q - qty
            last = at if q == 0 else last
        assert got[seq] == pytest.approx((q, cost / q if q else 0.0, pnl), abs=1e-6)
    times = L.position_times(df).first()
    assert (times.entry_ms, times.last_exit_ms) == (entry if q else None, last)
    assert L.fill_violations(df, cash=1e12).count() == 0


def test_recurrences_collect_no_rows(spark):
    """A hot key's rows go through in batches; nothing holds lists of them."""
    df = spark.createDataFrame([("k", i, 0.5, 1.0 if i else None) for i in range(40)], "k string, t bigint, a double, b double").repartition(3)
    out = linear_recurrences(df, ["k"], ["t"], {"y": (F.col("a"), F.col("b"), F.col("b"))}, y0=None, chunk=8, span=100)
    placed = [line for line in plan(out).splitlines() if "collect_list(struct(_n" in line]
    assert not placed and "MapInArrow" in plan(out)
    got, y = {x.t: x.y for x in out.collect()}, None
    for t in range(40):
        y = (1.0 if t else None) if y is None else 0.5 * y + 1.0
        assert got[t] == (None if y is None else pytest.approx(y))


def test_recurrences_over_spans(spark):
    r = random.Random(5)
    rows = [(k, t, r.uniform(-1, 1), r.uniform(-1, 1)) for k in "ab" for t in r.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k string, t bigint, a double, b double").repartition(4)
    out = linear_recurrences(df, ["k"], ["t"], {"y": (F.col("a"), F.col("b")), "z": (F.lit(0.5), F.col("b"))}, y0=2.0, chunk=8, span=50, before=True).collect()
    got = {(x.k, x.t): x for x in out}
    seeded = {(x.k, x.t): x.y for x in linear_recurrences(df, ["k"], ["t"], {"y": (F.lit(0.9), 0.1 * F.col("b"), F.col("b"))}, y0=None, chunk=8, span=3).collect()}
    for k in "ab":
        y, z, m = 2.0, 2.0, None
        for _, t, a, b in sorted(x for x in rows if x[0] == k):
            assert got[k, t].y_before == pytest.approx(y)
            y, z, m = a * y + b, 0.5 * z + b, b if m is None else 0.9 * m + 0.1 * b
            assert (got[k, t].y, got[k, t].z, seeded[k, t]) == pytest.approx((y, z, m))


@pytest.mark.parametrize("horizon", [0, 1, DAY // 3, DAY, 5 * DAY // 2, 400 * DAY])
def test_holds_by_composition(spark, horizon):
    """One symbol over many buckets against the loop; gaps, dense days and single entries."""
    r = random.Random(6)
    times = sorted({r.randrange(900) * DAY + r.randrange(96) * 900_000 for _ in range(500)} | {5 * DAY + k * 60_000 for k in range(200)} | {2000 * DAY})
    df = spark.createDataFrame([("S", t) for t in times] + [("T", times[3])], "symbol string, timestamp_ms bigint").repartition(5)
    want, last = [], None
    for t in times:
        if last is None or t >= last + horizon:
            want.append(t)
            last = t
    got = J.non_overlapping(df, horizon_ms=horizon).collect()
    assert sorted(x.timestamp_ms for x in got if x.symbol == "S") == want and [x.timestamp_ms for x in got if x.symbol == "T"] == [times[3]]


def test_holds_meet_distinct_times_only(spark):
    """Times are made distinct by hashing before they are listed, so rows are not sorted to collect sets."""
    df = spark.createDataFrame([("S", t * DAY) for t in (0, 0, 1, 5, 5, 6)], "symbol string, timestamp_ms bigint")
    out = J.non_overlapping(df, horizon_ms=5 * DAY)
    assert "collect_set" not in plan(out) and sorted(x.timestamp_ms // DAY for x in out.collect()) == [0, 5]
