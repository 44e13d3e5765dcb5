"""Golden values of rules that a query's SQL would only repeat."""

import pytest
from pyspark.sql import functions as F

from barflow.operators import attribution, calibrate, features, folds, learn, ledger, normalize, quality, snapshot
from barflow.sources import tables

DAY = 86_400_000


def metrics(spark, symbol, *, n=4, rows=1300, trades=30, gross=0.5, net=0.4, native=0.3, synthetic=0.1, share=0.2, auc=0.6, drawdown=0.1):
    """Rows of n folds: all, and the splits that are given (None: no such rows)."""
    out = []
    for f in range(n):
        out.append((f, "weighted", "global", symbol, "all", rows, trades, gross / n, net / n, auc, drawdown))
        if native is not None:
            out.append((f, "weighted", "global", symbol, "native", int(rows * (1 - share)), 0, 0.0, native / n, auc, drawdown))
        if synthetic is not None:
            out.append((f, "weighted", "global", symbol, "synthetic", int(rows * share), 0, 0.0, synthetic / n, auc, drawdown))
    names = "fold int, scenario string, scope string, symbol string, split string, row_count bigint, trades bigint, gross_return double, net_return double, roc_auc double, max_drawdown double"
    return spark.createDataFrame(out, names)


def test_weakness_needs_both_splits_and_lists_the_deciding_reasons(spark):
    frames = [
        metrics(spark, "fine"),
        metrics(spark, "no_synthetic", native=2.0, net=2.0, synthetic=None),  # 1 or more above a split that does not exist
        metrics(spark, "no_native", native=None, synthetic=-2.0, share=0.5),
        metrics(spark, "synthetic_loss", net=0.9, native=1.1, synthetic=-0.2, share=0.8),
        metrics(spark, "below", net=2.0, native=1.5, synthetic=0.5),
        metrics(spark, "sparse", n=3, rows=20, trades=1, net=-1.0, auc=0.4),
        metrics(spark, "costs", gross=0.1, net=-0.1),
        metrics(spark, "weak", auc=0.5),
        metrics(spark, "deep", drawdown=0.5),
    ]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    out = {r.symbol: (r.kind, r.reasons, r.eligible) for r in attribution.weakness(attribution.symbol_attribution(rows, slip=0.001)).collect()}
    assert out["fine"] == ("none", "", True) and out["no_synthetic"] == ("none", "", True) and out["no_native"] == ("none", "", True)
    assert out["synthetic_loss"] == ("synthetic_fragility", "synthetic_dominant_negative,synthetic_underperforms_native", False)
    assert out["below"] == ("synthetic_fragility", "synthetic_underperforms_native", False)
    assert out["sparse"] == ("sparse_history", "folds_lt_4,trades_lt_100,row_count_lt_5000", False)
    assert out["costs"] == ("cost_fragility", "fees_erase_edge,slippage_stress_non_positive", False)
    assert out["weak"] == ("weak_signal", "roc_auc_lt_0.52", False) and out["deep"] == ("none", "max_drawdown_gt_0.35", False)


def test_basis_takes_the_rate_and_needs_96_values(spark):
    n = 130
    bars = spark.createDataFrame([("A", i * DAY, 100.0 + i % 7, 1.0, "native", "trainable") for i in range(n)], "symbol string, timestamp_ms bigint, close double, volume double, source string, row_status string")
    series = lambda f: spark.createDataFrame([("A", i * DAY, f(i)) for i in range(n)], "symbol string, timestamp_ms bigint, close double")
    out = features.feature_table(bars, series(lambda i: 50.0), series(lambda i: 100.0 + i % 5), series(lambda i: 2.0), with_ema=False).orderBy("timestamp_ms").collect()
    assert abs(out[3].basis_level - 1.03) < 1e-6
    assert all(r.basis_zscore_96 == 0 for r in out[:95]) and out[96].basis_zscore_96 != 0
    gone = features.feature_table(bars, series(lambda i: 50.0), series(lambda i: 100.0), series(lambda i: 2.0 if i % 2 else None), with_ema=False)
    assert gone.agg(F.sum("basis_available"), F.sum(F.abs("basis_zscore_96"))).first()[:] == (65.0, 0.0)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "symbol string, fold_index int, scenario string, role string, y int")


def test_skip_reasons(spark):
    many = lambda s, f, role, n, ones=True: [(s, f, "weighted", role, int(ones and i % 2)) for i in range(n)]
    rows = many("A", 1, "train", 20) + many("A", 1, "valid", 6) + many("A", 2, "train", 20) + many("A", 3, "valid", 6) + many("A", 4, "train", 20, False) + many("A", 4, "valid", 6) + many("A", 5, "train", 20) + many("A", 5, "valid", 6, False)
    rows += many("A", 6, "train", 9) + many("A", 6, "valid", 6) + many("A", 7, "train", 20) + many("A", 7, "valid", 2, False)
    whole = {r.fold_index: r.reason for r in folds.skip_reasons(labelled(spark, rows), ("fold_index",)).collect()}
    assert whole == {1: None, 2: "valid has no rows", 3: "train has no rows", 4: "train must contain both classes, observed=[0]", 5: "valid must contain both classes, observed=[0]", 6: None, 7: "valid must contain both classes, observed=[0]"}
    own = {r.fold_index: r.reason for r in folds.skip_reasons(labelled(spark, rows), ("fold_index", "symbol"), min_train=10, min_valid=5).collect()}
    assert own == {1: None, 2: "valid_rows_lt_5", 3: "train_rows_lt_10", 4: "train_missing_class", 5: "valid_missing_class", 6: "train_rows_lt_10", 7: "valid_rows_lt_5"}


def test_walk_forward_trains_scenarios_and_eligible_symbols(spark, tmp_path):
    rows = [(s, 1, sc, role, i, float(i % 5), int(i % 5 > 2), "native", 0.01, 0.5) for s, n in (("A", 40), ("B", 12)) for sc in ("weighted", "native_only") for role in ("train", "valid") for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, fold_index int, scenario string, role string, timestamp_ms bigint, x double, y int, source string, forward_return double, supervised_row_weight double")
    folder = str(tmp_path)
    out = learn.walk_forward(df.where("not (scenario = 'native_only' and role = 'valid')"), ["x"], weight="supervised_row_weight", run_id="r", snapshot_id="s", trees=2, min_train=20, min_valid=20, folder=folder)
    assert tuple(out.columns) == learn.PREDICTION and len(out.columns) == 13
    counts = {(r.scenario, r.model_scope, r.model_symbol, r.symbol): r["count"] for r in out.groupBy("scenario", "model_scope", "model_symbol", "symbol").count().collect()}
    assert counts == {("weighted", "global", None, "A"): 40, ("weighted", "global", None, "B"): 12, ("weighted", "symbol", "A", "A"): 40}
    assert learn.walk_forward(df.limit(0), ["x"], weight="supervised_row_weight", run_id="r", snapshot_id="s").count() == 0
    with pytest.raises(ValueError, match="fold=1 scenario=weighted valid has no rows"):
        learn.walk_forward(df.where("role = 'train'"), ["x"], weight="supervised_row_weight", run_id="r", snapshot_id="s")
    # A fit reads the files of its own partitions alone, and the library scans what it has written.
    one = spark.read.parquet(f"{folder}/assigned").where("scenario = 'weighted' and fold_index = 1 and symbol = 'B'")
    assert {p.split("/assigned/")[1].rsplit("/", 1)[0] for p in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"scenario=weighted/fold_index=1/symbol=B"}
    scanned = tables.prediction_scan(spark, [f"{folder}/predictions"], scenario="weighted").collect()
    want = sorted(scanned, key=lambda r: (r.timestamp_ms, -r.probability, r.symbol))
    assert len(scanned) == 52 and scanned == want and {(r.fold, r.scope) for r in scanned} == {(1, "global")}


def test_chain_from_written_predictions_to_trades(spark, tmp_path):
    """Metrics, gates and trades of a run's own predictions against a small loop."""
    from barflow.operators import attribution, metrics, trades
    from barflow.plans import learning

    import random

    r = random.Random(3)
    rows = [(s, f, sc, role, (f * 40 + i) * DAY, float(x := r.randrange(5)), int(x + r.randrange(3) > 3), "native", r.uniform(-0.02, 0.03), 0.5) for s in "ABC" for f in (1, 2) for sc in ("weighted", "native_only") for role in ("train", "valid") for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, fold_index int, scenario string, role string, timestamp_ms bigint, x double, y int, source string, forward_return double, supervised_row_weight double")
    learn.walk_forward(df, ["x"], weight="supervised_row_weight", run_id="r", snapshot_id="s", trees=3, folder=str(tmp_path))
    got = {(x.part, x.scenario, x.name): x.value for x in learning.chain_results(spark, [f"{tmp_path}/predictions"], metrics, attribution, trades).collect()}
    preds = spark.read.parquet(f"{tmp_path}/predictions").where("model_scope = 'global'").collect()
    th, fee = learning.CHAIN_TH, learning.CHAIN_FEE
    for sc in ("weighted", "native_only"):
        taken = [p for p in preds if p.scenario == sc and p.probability >= th]
        assert got["metrics", sc, "trades"] == len(taken) > 0 and got["metrics", sc, "net_return"] == pytest.approx(sum(p.forward_return - 2 * fee for p in taken))
        assert got["gate", sc, "min_trades"] == len(taken)
    (chosen,) = (k[1] for k in got if k[0] == "choice")
    bars = {}
    for p in preds:
        if p.scenario == chosen and p.probability >= th:
            bars.setdefault(p.timestamp_ms, []).append(p)
    made = [p for ps in bars.values() for p in sorted(ps, key=lambda p: (-p.probability, p.symbol))[: learning.CHAIN_K]]
    pnl = sum(1000 * (1 + p.forward_return) * (1 - fee) - 1000 * (1 + fee) for p in made)
    assert got["trades", None, "trades"] == len(made) and got["trades", None, "net_pnl"] == pytest.approx(pnl) and got["trades", None, "equity"] == pytest.approx(100_000 + pnl)


def test_symbols_without_native_history_come_by_the_shared_context(spark):
    bar = "venue string, symbol string, timestamp_ms bigint, open double, high double, low double, close double, volume double, source string"
    row = lambda v, s, t, p: (v, s, t * DAY, p, p, p, p, 1.0, v)
    native = spark.createDataFrame([row("native", "A", t, 100.0) for t in range(3)] + [row("native", "C", t, 30.0) for t in range(3)], bar)
    ext = spark.createDataFrame([row("ext_a", "A", t, 50.0) for t in range(4)] + [row("ext_a", "B", t, 7.0) for t in range(3)] + [row("ext_b", "C", t, 10.0) for t in range(3)] + [row("ext_b", "D", t, 5.0) for t in range(3)], bar)
    ext = ext.withColumn("quote_currency", F.when(F.col("venue") == "ext_b", "CAD").otherwise("USD"))
    fx = spark.createDataFrame([(t * DAY, 2.0) for t in range(4)], "timestamp_ms bigint, rate double")
    obs = normalize.overlap_observations(native, ext, fx)
    selection = ext.select("symbol", "venue", "quote_currency").distinct()
    shared = normalize.shared_context(obs, selection)
    pooled = {r.quote_group: (r.ratio_median, r.basis_median) for r in shared.where("month = '*'").collect()}
    assert pooled == {"USD": (2.0, 1.0), "CAD": (3.0, 3.0)}  # a quote in the account's currency has the rate 1
    out = {(r.symbol, r.timestamp_ms // DAY): (r.rate, r.factor) for r in normalize.factors(ext, normalize.conversion_context(obs, ["venue", "symbol"]), fx, ["venue", "symbol"], shared).collect()}
    assert out["B", 0] == (2.0, 2.0) and out["D", 1] == (1.0, 3.0) and out["A", 3] == (2.0, 2.0) and out["C", 0] == (1.0, 3.0)


def test_snapshot_fails_on_a_missing_weight_and_has_all_columns(spark):
    bars = spark.createDataFrame([("A", i * DAY, 1.0, 1.0, 1.0, 100.0 + i, 1.0, "native" if i % 2 else "synthetic") for i in range(6)], "symbol string, timestamp_ms bigint, open double, high double, low double, close double, volume double, source string")
    weights = spark.createDataFrame([("A", "1970-01", 0.4, True)], "symbol string, month string, weight_final double, supervised_eligible boolean")
    made = snapshot.build(bars, weights, horizon=1, interval_ms=DAY, fee=0.0)
    assert tuple(made.columns) == snapshot.COLUMNS and len(made.columns) == 22
    assert sorted({r.effective_monthly_weight for r in made.collect()}) == [0.4, 1.0]
    with pytest.raises(Exception, match="no weight of A in 1970-01"):
        snapshot.build(bars, weights.limit(0), horizon=1, interval_ms=DAY, fee=0.0).collect()
    assert snapshot.missing_weights(bars, weights.limit(0)).collect() == [("A", "1970-01")]


def test_seal_refuses_other_content(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1)], "symbol string, v int")
    assert snapshot.seal(rows, "d1", str(tmp_path), "one") and not snapshot.seal(rows, "d1", str(tmp_path), "one")
    with pytest.raises(ValueError, match="other content"):
        snapshot.seal(rows, "d2", str(tmp_path), "one")
    (tmp_path / "half").mkdir()
    with pytest.raises(ValueError, match="incomplete"):
        snapshot.seal(rows, "d1", str(tmp_path), "half")


def test_coverage_statuses(spark):
    bars = spark.createDataFrame([("ext_a", "A", 0, "ext_a"), ("ext_a", "A", DAY, "ext_a")], "dataset string, symbol string, timestamp_ms bigint, source string")
    expected = spark.createDataFrame([("ext_a", s, p, f) for s, p, f in (("A", True, True), ("B", True, True), ("C", True, False), ("D", False, False))], "dataset string, symbol string, has_pair boolean, has_file boolean")
    out = {r.symbol: r.status for r in quality.coverage_report(bars, expected, interval_ms=DAY).collect()}
    assert out == {"A": "ok", "B": "empty", "C": "missing_file", "D": "no_pair", "*": "partial"}


def test_gates_take_the_first_breaching_symbol(spark):
    report = spark.createDataFrame([("A", 0, 1.0), ("C", 99, 0.1), ("B", 3, 0.5)], "symbol string, gap_count bigint, coverage_pct double")
    breach = attribution.first_breach(report, max_gaps=10, min_coverage=0.9)
    assert breach.first().breach_symbol == "B" and breach.first().breach[:] == ("combined_coverage", 0.5, 0.9)
    facts = spark.createDataFrame([("weighted", 13, 500, 1.0, 0.1, False, None), ("native_only", 13, 500, 1.0, 0.1, True, None)], "scenario string, folds bigint, trades bigint, net_return double, max_drawdown double, parity boolean, pass_rate double")
    facts = facts.withColumn("k", F.lit(1)).join(breach.select("breach", F.lit(1).alias("k")), "k")
    got = sorted((r.scenario, r.gate, r.observed) for r in attribution.gates(facts, slip=0.0001, min_folds=13, min_trades=100).collect())
    assert got == [("native_only", "combined_coverage", 0.5), ("weighted", "combined_coverage", 0.5), ("weighted", "conversion_pass_rate", None), ("weighted", "snapshot_parity", 0.0)]


def test_pass_rate_falls_back_on_the_latest_quality_rows(spark):
    weights = spark.createDataFrame([("A", True), ("B", False)], "symbol string, supervised_eligible boolean")
    rows = [("A", "2024-01", 50, False, "1"), ("A", "2024-01", 50, True, "2"), ("A", "2024-02", 50, False, "1"), ("A", "2024-03", 5, True, "1"), ("Z", "2024-01", 50, True, "1")]
    q = spark.createDataFrame(rows, "symbol string, period string, overlap_rows int, quality_pass boolean, updated string")
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    rate = lambda w: calibrate.conversion_pass_rate(w, q, symbols, min_rows=12).first()[0]
    assert rate(weights) == 0.5 and rate(weights.limit(0)) == 0.5 and rate(weights.where("symbol = 'A'")) == 1.0
    assert calibrate.conversion_pass_rate(weights.limit(0), q.limit(0), symbols, min_rows=12).first()[0] is None


def test_last_row_of_a_time_wins(spark):
    rows = spark.createDataFrame([("A", 1, 5.0, 0), ("A", 1, 3.0, 1), ("A", 2, 7.0, 2)], "symbol string, timestamp_ms bigint, close double, seq int")
    assert sorted(map(tuple, tables.close_series(rows, seq="seq").collect())) == [("A", 1, 3.0), ("A", 2, 7.0)]


def test_drawdown_across_buckets_equals_one_pass(spark):
    import random

    from barflow.operators import metrics as M

    r = random.Random(3)
    rows = [(i * 17 % 500 * 7, r.uniform(-1, 1), 0.9, str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "timestamp_ms bigint, forward_return double, probability double, k string").selectExpr("*", "'A' as g")
    cum = top = fall = 0.0
    top = None
    for _, v, _, _ in sorted(rows, key=lambda x: (x[0], x[3])):
        cum += v
        top = cum if top is None else max(top, cum)
        fall = max(fall, top - cum)
    for bucket in (None, 10, 333, 10**9):
        got = M.drawdown(df, ["g"], ["timestamp_ms", "k"], threshold=0.5, fee=0.0, bucket_ms=bucket).first().max_drawdown
        assert abs(got - fall) < 1e-9


def test_cash_cap_and_slippage_breach(spark):
    df = spark.createDataFrame([(5.0, 10.0), (12.0, 10.0), (12.0, -1.0)], "cash double, available double")
    assert [r[0] for r in df.select(ledger.cap_cash(F.col("cash"), F.col("available"))).collect()] == [5.0, 10.0, 0.0]
    assert [r[0] for r in df.select(ledger.slippage_breach(F.col("cash") / 100, 0.1)).collect()] == [False, True, True]


def test_books_without_a_balance_are_capped_at_nothing(spark):
    books = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "account string, cash double")
    balances = spark.createDataFrame([("a", 4.0, 1.0), ("a", 3.0, 1.0), ("b", 4.0, 1.0)], "account string, amount double, hold double")
    out = {r.account: (r.new_cash, r.capped) for r in ledger.cap_books(books, balances).collect()}
    assert out == {"a": (5.0, False), "b": (3.0, True), "c": (0.0, True)}


def test_slippage_breaches_add_to_the_streak_and_halt(spark):
    rows = [("r", "d", 1, False, 1, 0), ("r", "d", 2, True, 0, 2), ("r", "d", 3, True, 0, 0), ("r", "d", 4, False, 1, None), ("r", "e", 1, False, 2, 1)]
    df = spark.createDataFrame(rows, "runner string, day string, seq int, ok boolean, errors int, breaches int")
    out = {(r.day, r.seq): (r.consecutive_errors, r.level) for r in ledger.error_streaks(df, limit=5).collect()}
    assert out == {("d", 1): (1, "ok"), ("d", 2): (3, "halt"), ("d", 3): (0, "ok"), ("d", 4): (1, "ok"), ("e", 1): (3, "halt")}
    assert ledger.error_streaks(df.drop("breaches"), limit=5).where("level = 'halt'").count() == 0


def test_upserts_rewrite_touched_partitions_alone(spark, tmp_path):
    from barflow.sources import tables as A

    kind, path = "symbol string, day string, t int, v double, seq int", str(tmp_path / "t")
    up = lambda rows, batch: A.upsert_partitions(spark, spark.createDataFrame(rows, kind), path, keys=["symbol", "day", "t"], by=["day"], seq="seq", batch=batch)
    read = lambda: sorted((r.symbol, r.day, r.t, r.v) for r in spark.read.parquet(path).collect())
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    up([("A", "d1", 1, 1.0, 0), ("A", "d2", 1, 2.0, 0), ("B", "d3", 1, 3.0, 0)], 1)
    old = files()
    up([("A", "d2", 1, 5.0, 1), ("A", "d2", 1, 4.0, 0), ("C", "d4", 1, 9.0, 0)], 2)
    new = files()
    assert read() == [("A", "d1", 1, 1.0), ("A", "d2", 1, 5.0), ("B", "d3", 1, 3.0), ("C", "d4", 1, 9.0)]
    assert {f for f in old if new.get(f) != old[f]} == {f for f in old if "day=d2" in f}
    up([("A", "d2", 1, 7.0, 9)], 1)  # an old increment that runs again
    assert files() == new
    up([("A", "d2", 1, 5.0, 1), ("A", "d2", 1, 4.0, 0), ("C", "d4", 1, 9.0, 0)], 2)  # the last one again
    assert files() == new
    A.upsert_partitions(spark, spark.createDataFrame([(f"S{k}", f"d{k}", 1, 0.0, 0) for k in range(5)], kind), path, keys=["symbol", "day", "t"], by=["day"], seq="seq", batch=3, listed=2)
    assert len(read()) == 9
