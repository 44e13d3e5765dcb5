import math
import random

import pytest
from pyspark.sql import functions as F

from barflow.operators import attribution as I
from barflow.operators import folds as H
from barflow.operators import metrics as M
from barflow.operators import trades as J
from barflow.plans import evaluate as E

PREDS = "fold int, scenario string, scope string, symbol string, timestamp_ms bigint, source string, y int, forward_return double, probability double, row_key string"


def ms(day):
    import datetime as dt

    return int(dt.datetime.fromisoformat(day + "+00:00").timestamp() * 1000)


def test_folds_golden(spark):
    df = spark.createDataFrame([(ms("2025-01-01T00:00:00"),), (ms("2026-03-31T23:45:00"),)], "timestamp_ms bigint")
    months = H.full_months(df, interval_ms=900_000)
    assert months.count() == 15
    out = H.walk_forward_folds(months, train=12, valid=1, step=1, last=2).orderBy("fold_index").collect()
    assert [(r.fold_index, r.train_start, r.train_end, r.valid_start) for r in out] == [(1, "2025-02", "2026-01", "2026-02"), (2, "2025-03", "2026-02", "2026-03")]
    with pytest.raises(Exception, match="insufficient full months for walk-forward folds: have=1 need>=13"):
        H.walk_forward_folds(months.limit(1), train=12, valid=1, step=1, last=2).collect()


def test_required_scenario_must_not_be_skipped(spark):
    df = spark.createDataFrame([("weighted", 1, None), ("weighted", 2, "valid has no rows"), ("native_only", 1, "train has no rows")], "scenario string, fold_index int, reason string")
    assert {r.scenario: r.status for r in H.scenario_status(df).collect()} == {"weighted": "partial", "native_only": "skipped"}
    assert H.scenario_status(df, required="native").count() == 2
    with pytest.raises(Exception, match="fold=2 scenario=weighted valid has no rows"):
        H.scenario_status(df, required="weighted").collect()


def test_trading_golden(spark):
    rows = [(1, "w", "global", "A", 1, "native", 1, 0.02, 0.9, "a"), (1, "w", "global", "A", 2, "synthetic", 0, 0.01, 0.8, "b"), (1, "w", "global", "A", 3, "synthetic", 0, 0.5, 0.1, "c")]
    out = {(r.symbol, r.split): r for r in M.fold_metrics(spark.createDataFrame(rows, PREDS), threshold=0.6, fee=0.002, order=["timestamp_ms", "row_key"]).collect()}
    row = out[("*", "all")]
    assert (row.trades, round(row.gross_return, 9), round(row.net_return, 9)) == (2, 0.03, 0.022)
    assert (out[("A", "synthetic")].row_count, out[("A", "synthetic")].trades) == (2, 1) and out[("*", "native")].roc_auc is None


def test_ranking_with_ties_matches_pairs(spark):
    r = random.Random(2)
    rows = [(1, "w", "g", "A", i, "native", int(r.random() < 0.3), 0.0, r.randrange(6) / 5, str(i)) for i in range(300)]
    got = M.ranking(spark.createDataFrame(rows, PREDS), ["fold"]).first()
    pos, neg = [x[8] for x in rows if x[6]], [x[8] for x in rows if not x[6]]
    assert math.isclose(got.roc_auc, sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
    ap = prev = 0.0
    for t in sorted({x[8] for x in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(x[8] >= t for x in rows)
        ap += (tp / len(pos) - prev) * tp / n
        prev = tp / len(pos)
    assert math.isclose(got.pr_auc, ap)


@pytest.mark.parametrize(("returns", "want"), [([-0.05], 0.0), ([0.05, -0.03, -0.02, 0.1], 0.05), ([0.01, 0.02], 0.0)])
def test_drawdown_starts_at_first_value(spark, returns, want):
    rows = [(1, "w", "g", "A", i, "native", 1, v, 0.9, str(i)) for i, v in enumerate(returns)]
    got = M.drawdown(spark.createDataFrame(rows, PREDS), ["fold"], ["timestamp_ms"], threshold=0.5, fee=0.0).first()
    assert abs(got.max_drawdown - want) < 1e-12


def test_trade_pnl_golden_and_holds(spark):
    df = spark.createDataFrame([("A", 1, 0.10)], "symbol string, timestamp_ms bigint, forward_return double")
    assert abs(J.trade_pnl(df, notional=5000.0, cost=0.002).first().net_pnl - 479.0) < 1e-9
    times = spark.createDataFrame([("A", t) for t in (0, 1, 2, 3, 4, 7, 4)], "symbol string, timestamp_ms bigint")
    assert sorted(r.timestamp_ms for r in J.non_overlapping(times, horizon_ms=2).collect()) == [0, 2, 4, 7]


def test_topk_keeps_rejected_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.69), (1, "c", 0.7), (2, "a", 0.1)], "timestamp_ms bigint, symbol string, probability double")
    out = {(r.timestamp_ms, r.symbol): r.outcome for r in J.topk_per_bar(df, k=1).collect()}
    assert out == {(1, "a"): "accepted", (1, "b"): "capacity", (1, "c"): "capacity", (2, "a"): "accepted"}


def test_holds_of_many_blocks_equal_a_loop(spark):
    times = [t * 3 % 1009 for t in range(1009)]
    df = spark.createDataFrame([("A", 2, t) for t in times] + [("B", 5, t) for t in times], "symbol string, h bigint, timestamp_ms bigint")
    got = {(r.symbol, r.timestamp_ms) for r in J.non_overlapping(df, horizon_ms=F.col("h"), keys=("symbol", "h"), bucket_ms=7).collect()}
    want = {("A", t) for t in range(0, 1009, 2)} | {("B", t) for t in range(0, 1009, 5)}
    assert got == want


def test_sweep_holds_before_the_best_of_a_bar(spark):
    rows = [("A", 0, 0.9, 0.1, "a"), ("B", 0, 0.8, -0.2, "b"), ("A", 1, 0.9, 0.1, "c"), ("B", 1, 0.7, 0.1, "d"), ("A", 5, 0.6, 0.1, "e")]
    df = spark.createDataFrame(rows, "symbol string, timestamp_ms bigint, probability double, forward_return double, row_key string")
    configs = [(0.5, 1, 0.0, 0), (0.5, 1, 0.0, 5), (0.75, 2, 0.0, 0), (0.99, 1, 0.0, 0)]
    out = {r.config: r for r in J.sweep(df, configs, notional=100.0, capital=1000.0, horizon_ms=2).collect()}
    assert {c: (r.trades, round(r.net_pnl, 6), round(r.equity, 6)) for c, r in out.items()} == {0: (3, 30.0, 1030.0), 1: (2, 20.0, 1020.0), 2: (3, 0.0, 1000.0)}
    assert out[0].win_rate == 1.0 and out[0].annualized_return is None and abs(out[2].max_drawdown_pct - 0.01) < 1e-12
    assert J.sweep(df.limit(0), configs, notional=100.0, capital=1000.0, horizon_ms=2).count() == 0


def test_total_metrics_are_the_coarsest_rows_of_fold_metrics(spark):
    rows = [(f, "w", "global", "AB"[i % 2], i // 2, "native" if i % 3 else "x", i % 2, (i * 7 % 11 - 5) / 50, (i * 5 % 13) / 13, str(i)) for f in (1, 2) for i in range(40)]
    preds = spark.createDataFrame(rows, PREDS)
    spec = {"threshold": 0.4, "fee": 0.001, "order": ["timestamp_ms", "symbol", "row_key"]}
    mine = M.total_metrics(preds, **spec)
    other = M.fold_metrics(preds.withColumn("real", F.col("symbol")), **spec | {"order": ["timestamp_ms", "real", "row_key"]}).where("symbol = '*' and split = 'all'")
    flat = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(mine.columns)).collect())
    assert flat(mine) == flat(other) and mine.count() == 2


def test_drawdowns_of_all_grains_from_one_order(spark):
    """Against a loop over each grain; rows of a time are in the order of their own symbol, also under ``*``."""
    r = random.Random(7)
    rows = [(1, "w", "g", r.choice("AB"), r.randrange(6) * 43_200_000, r.choice(["native", "x"]), 1, r.uniform(-0.1, 0.1), r.random(), f"{r.randrange(10**6):06d}{i}") for i in range(200)]
    got = {(x.symbol, x.split): x.max_drawdown for x in M.fold_metrics(spark.createDataFrame(rows, PREDS).repartition(3), threshold=0.3, fee=0.0, order=["timestamp_ms", "symbol", "row_key"]).collect()}
    for symbol, split in got:
        mine = [x for x in rows if symbol in ("*", x[3]) and split in ("all", "native" if x[5] == "native" else "synthetic") and x[8] >= 0.3]
        cum, top, fall = 0.0, None, 0.0
        for x in sorted(mine, key=lambda x: (x[4], x[3], x[9])):
            cum += x[7]
            top = cum if top is None else max(top, cum)
            fall = max(fall, top - cum)
        assert got[symbol, split] == pytest.approx(fall, abs=1e-12)
    assert len(got) == 9


def test_sums_by_score_equal_metrics_of_rows(spark):
    """Also with nulls, which averages leave out; without other splits' drawdown and ranking the attribution is the same."""
    r = random.Random(5)
    rows = [(r.randrange(2), "w", "g", r.choice("AB"), i * 7_200_000, r.choice(["native", "x"]), r.choice([0, 1, 1, None]), r.choice([r.uniform(-0.1, 0.1), 0.004, None]), r.randrange(20) / 19, f"{i:04d}") for i in range(300)]
    preds = spark.createDataFrame(rows, PREDS)
    spec, keys = {"threshold": 0.4, "fee": 0.002}, ["fold", "scenario", "scope", "symbol", "split"]
    grains = M.splits(preds).withColumns({"real": F.col("symbol"), "symbol": F.explode(F.array("symbol", F.lit("*")))})
    parts = [M.drawdown(grains, keys, ["timestamp_ms", "real", "row_key"], **spec), M.probability_loss(grains, keys), M.ranking(grains, keys)]
    want = M.trading(grains, keys, **spec)
    for part in parts:
        want = want.join(part, keys)
    order = ["timestamp_ms", "symbol", "row_key"]
    full = M.fold_metrics(preds, **spec, order=order)
    flat = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in x) for x in df.select(*sorted(want.columns)).collect())
    assert flat(full) == flat(want)
    scores = M.by_score(preds, fee=0.002)
    some = {"splits": ("all",), "symbols": ("own",)}
    falls = M.falls_of(M.trade_runs(preds, thresholds={"x": 0.4, "y": 0.9}, fee=0.002, order=order, splits=("all",)), "x", order=order, **some)
    light = I.symbol_attribution(M.metrics_of(scores, falls, M.ranks_of(scores, **some), threshold=0.4, **some), slip=0.001)
    sums = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in x) for x in df.collect())
    assert sums(light) == sums(I.symbol_attribution(full, slip=0.001))


def test_promotion_reads_predictions_twice(spark, monkeypatch):
    """Once by score and once for the trades' order, whatever is made of them."""
    rows = [(f, s, "global", "AB"[i % 2], i // 2, "native" if i % 3 else "x", i % 2, (i * 7 % 11 - 5) / 50, (i * 5 % 13) / 13, str(i)) for f in (1, 2) for s in ("weighted", "native_only") for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def count(_):
        seen.add(1)
        return True

    preds = spark.createDataFrame(rows, PREDS).where(F.udf(count, "boolean").asNondeterministic()("row_key"))
    monkeypatch.setattr(E.X, "preds", lambda spark, sf: preds)
    got = E.promotion_record(spark, "/root/testdata/sf0.001").collect()
    assert [r.type for r in got].count("decision") == 1 and seen.value == 2 * len(rows)
