import random
import statistics

from barflow.operators import calibrate as C
from barflow.operators import normalize as N
from barflow.operators import snapshot as S

DAY = 86_400_000


def test_nearest_asof_matches_brute_force(spark):
    r = random.Random(3)
    rates = sorted({r.randrange(0, 400 * DAY, 1000) for _ in range(60)})
    left = [r.randrange(0, 500 * DAY, 500) for _ in range(300)] + rates[:5]
    fx = spark.createDataFrame([(t, float(i)) for i, t in enumerate(rates)], "timestamp_ms bigint, rate double")
    out = N.asof_nearest(spark.createDataFrame([(t,) for t in left], "timestamp_ms bigint"), fx).collect()
    want = lambda t: float(min(range(len(rates)), key=lambda i: (abs(rates[i] - t), rates[i])))
    assert len(out) == len(left) and all(x.rate == want(x.timestamp_ms) for x in out)
    back = N.asof_nearest(spark.createDataFrame([(t,) for t in left], "timestamp_ms bigint"), fx, direction="backward", tolerance_ms=20 * DAY).collect()
    for x in back:
        older = [i for i, t in enumerate(rates) if t <= x.timestamp_ms and x.timestamp_ms - t <= 20 * DAY]
        assert x.rate == (float(older[-1]) if older else None)


def test_trimmed_median(spark):
    few, many = [1.0, 2.0, 9.0], [float(i) for i in range(40)]
    df = spark.createDataFrame([("a", v) for v in few] + [("b", v) for v in many], "k string, v double")
    out = {r.k: r.value for r in N.robust_median(df, ["k"], "v").collect()}
    assert out == {"a": 2.0, "b": statistics.median(many[2:38])}


def test_factor_cascade_stops_at_present_basis(spark):
    df = spark.createDataFrame([(2.0, -1.0, 3.0, 5.0, 7.0), (2.0, None, 3.0, 5.0, 7.0), (None, None, None, None, 7.0)], "rate double, bm double, bg double, rm double, rg double")
    own = {"basis_month": df.bm, "basis_global": df.bg, "ratio_month": df.rm, "ratio_global": df.rg}
    assert [r[0] for r in df.select(N.conversion_factor(df.rate, own)).collect()] == [5.0, 6.0, 7.0]


def test_combined_precedence_scales_prices_not_volume(spark):
    s = "symbol string, timestamp_ms bigint, open double, high double, low double, close double, volume double, source string"
    native = spark.createDataFrame([("A", DAY, 1.0, 1.0, 1.0, 1.0, 5.0, "native")], s)
    ext = spark.createDataFrame([("A", k * DAY, 2.0, 2.0, 2.0, 2.0, 7.0, t, f) for k, t, f in ((1, "ext_a", 2.0), (2, "ext_a_fill", 2.0), (3, "ext_a", None))], s + ", factor double")
    fb = spark.createDataFrame([("A", 3 * DAY, 4.0, 4.0, 4.0, 4.0, 9.0, "ext_b", 0.5), ("A", 3 * DAY + 1, 4.0, 4.0, 4.0, 4.0, 9.0, "ext_b", 0.5)], s + ", factor double")
    out = N.combined_bars(native, ext, fb, interval_ms=DAY).orderBy("timestamp_ms").collect()
    assert [(r.close, r.volume, r.source) for r in out] == [(1.0, 5.0, "native"), (4.0, 7.0, "synthetic_fill"), (2.0, 9.0, "synthetic")]


def test_eligibility_modes(spark):
    rows = [("A", "2025-12", 0, 1.0, 0.0), ("A", "2026-01", 50, 0.0, 0.9), ("A", "2026-02", 0, 1.0, 0.0), ("A", "2026-03", 3, 0.5, 0.0), ("B", "2026-01", 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, month string, overlap_rows bigint, median_ape_close double, ret_corr double")
    out = {(r.symbol, r.month): (r.eligibility_mode, r.anchor_month) for r in C.eligibility(df, min_rows=10, max_ape=0.05, least_rows=10).collect()}
    assert out[("A", "2025-12")] == ("carry_backward", "2026-01") and out[("A", "2026-01")] == ("direct", "2026-01")
    assert out[("A", "2026-02")] == ("carry_forward", "2026-01") and out[("A", "2026-03")][0] == "blocked" and out[("B", "2026-01")] == ("blocked", None)


def test_horizon_labels(spark):
    i = 900_000
    rows = [("A", k * i, c, "native") for k, c in enumerate((100.0, 101.0, 102.0, 103.0), 1)]
    df = spark.createDataFrame(rows, "symbol string, timestamp_ms bigint, close double, source string")
    w = spark.createDataFrame([], "symbol string, month string, weight_final double, supervised_eligible boolean")
    out = S.build(df, w, horizon=2, interval_ms=i, fee=0.002).orderBy("timestamp_ms").collect()
    assert [r.row_status for r in out] == ["trainable"] * 2 + ["unlabeled_missing_horizon"] * 2
    assert abs(out[0].forward_return - 0.02) < 1e-12 and abs(out[1].forward_return - (103 / 101 - 1)) < 1e-12 and out[2].y is None


def test_seal_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("A", 1)], "symbol string, timestamp_ms bigint")
    assert S.seal(df, "d1", str(tmp_path)) and not S.seal(df, "d1", str(tmp_path)) and S.seal(df, "d2", str(tmp_path))


def test_eligibility_asks_for_250_rows_at_least(spark):
    """Golden: a quarter of the quality rule's rows, but never below 250, whatever that rule is."""
    df = spark.createDataFrame([("A", f"2025-{m:02d}", n, 0.01, 0.9) for m, n in ((1, 249), (2, 250), (3, 499), (4, 500))], "symbol string, month string, overlap_rows int, median_ape_close double, ret_corr double")
    direct = lambda **k: [r.month[-1] for r in C.eligibility(df, max_ape=0.05, **k).where("eligibility_mode = 'direct'").orderBy("month").collect()]
    assert direct(min_rows=12) == direct(min_rows=1000) == ["2", "3", "4"] and direct(min_rows=2000) == ["4"] and direct(min_rows=10_000) == []
