"""Metrics, attribution, gates and trade evaluation of predictions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as I
from ..operators import calibrate as C
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import snapshot as S
from ..operators import trades as J
from ..sources import fixtures as X
from ..sources.staging import staged
from . import ORACLES, QUERIES, VIEWS, query
from .fusion import MIN_ROWS
from .snapshots import ASOF, Snapshot

DAY, TH, FEE, SLIP = X.DAY, 0.6, 0.002, 0.001
GATE_TH = 0.65  # entry threshold of the promotion: the gates score the predictions anew
MAX_GAPS, MIN_COVERAGE = 10, 0.95
ORDER = ["timestamp_ms", "symbol", "row_key"]
G = "fold, scenario, scope, symbol, split"
P = f"greatest(1e-6, least(1 - 1e-6, probability))"

VIEWS |= {
    "grain": """SELECT * EXCLUDE (symbol, split), unnest([symbol, '*']) AS symbol, split FROM (SELECT *, unnest(['all', CASE WHEN source = 'native' THEN 'native' ELSE 'synthetic' END]) AS split FROM preds)""",
    "mtrade": f"""SELECT {G}, count(*) AS row_count, count(*) FILTER (probability >= {TH}) AS trades, coalesce(sum(forward_return) FILTER (probability >= {TH}), 0) AS gross_return,
      coalesce(sum(forward_return - 2 * {FEE}::DOUBLE) FILTER (probability >= {TH}), 0) AS net_return, avg((forward_return - 2 * {FEE}::DOUBLE > 0)::INT) FILTER (probability >= {TH}) AS win_rate FROM grain GROUP BY ALL""",
    "mcum": f"SELECT {G}, timestamp_ms, row_key, sum(forward_return - 2 * {FEE}::DOUBLE) OVER (PARTITION BY {G} ORDER BY timestamp_ms, real_symbol, row_key ROWS UNBOUNDED PRECEDING) AS cum, real_symbol FROM grain2 WHERE probability >= {TH}",
    "grain2": """SELECT * EXCLUDE (symbol, split), symbol AS real_symbol, unnest([symbol, '*']) AS symbol, split FROM (SELECT *, unnest(['all', CASE WHEN source = 'native' THEN 'native' ELSE 'synthetic' END]) AS split FROM preds)""",
    "mdraw": f"SELECT {G}, max(top - cum) AS max_drawdown FROM (SELECT *, max(cum) OVER (PARTITION BY {G} ORDER BY timestamp_ms, real_symbol, row_key ROWS UNBOUNDED PRECEDING) AS top FROM mcum) GROUP BY ALL",
    "mloss": f"SELECT {G}, avg(-(y * ln({P}) + (1 - y) * ln(1 - {P}))) AS logloss, avg(({P} - y) * ({P} - y)) AS brier FROM grain GROUP BY ALL",
    "mtied": f"SELECT {G}, probability, sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS fp FROM grain GROUP BY ALL",
    "mrank0": f"SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM mtied WINDOW w AS (PARTITION BY {G} ORDER BY probability DESC ROWS UNBOUNDED PRECEDING)",
    "mrank": f"""SELECT {G}, CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)) END AS roc_auc,
      CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp * (ctp / (ctp + cfp))) / sum(tp) END AS pr_auc FROM mrank0 GROUP BY ALL""",
    "fmetrics": f"SELECT * REPLACE (coalesce(max_drawdown, 0) AS max_drawdown) FROM mtrade LEFT JOIN mdraw USING ({G}) JOIN mloss USING ({G}) JOIN mrank USING ({G})",
    "msum": """SELECT scenario, scope, sum(row_count)::BIGINT AS row_count, sum(trades)::BIGINT AS trades, sum(gross_return) AS gross_return, sum(net_return) AS net_return, avg(win_rate) AS win_rate, avg(max_drawdown) AS max_drawdown,
      avg(logloss) AS logloss, avg(brier) AS brier, avg(roc_auc) AS roc_auc, avg(pr_auc) AS pr_auc, count(*) AS folds FROM fmetrics WHERE split = 'all' AND symbol = '*' GROUP BY 1, 2""",
    "attr": f"""SELECT *, synthetic_rows / greatest(1, row_count) AS synthetic_share, net_return - 2 * trades * {SLIP}::DOUBLE AS stressed_net FROM (SELECT scenario, scope, symbol, count(DISTINCT fold) FILTER (split = 'all') AS folds,
      coalesce(sum(row_count) FILTER (split = 'all'), 0)::BIGINT AS row_count, coalesce(sum(trades) FILTER (split = 'all'), 0)::BIGINT AS trades, coalesce(sum(gross_return) FILTER (split = 'all'), 0) AS gross_return, coalesce(sum(net_return) FILTER (split = 'all'), 0) AS net_return,
      sum(net_return) FILTER (split = 'native') AS native_net, sum(net_return) FILTER (split = 'synthetic') AS synthetic_net, coalesce(sum(row_count) FILTER (split = 'synthetic'), 0)::BIGINT AS synthetic_rows,
      avg(roc_auc) FILTER (split = 'all') AS roc_auc, avg(max_drawdown) FILTER (split = 'all') AS max_drawdown FROM fmetrics WHERE symbol <> '*' GROUP BY 1, 2, 3)""",
    "weak0": """SELECT *, folds < 4 AS r1, trades < 100 AS r2, row_count < 5000 AS r3, gross_return > 0 AND net_return <= 0 AS r4, stressed_net <= 0 AS r5, coalesce(synthetic_share >= 0.7 AND synthetic_net < 0, false) AS r6,
      coalesce(synthetic_net <= native_net - 1, false) AS r7, net_return < 0 AS r8, coalesce(roc_auc < 0.52, false) AS r9, coalesce(max_drawdown > 0.35, false) AS r10 FROM attr""",
    "weak1": "SELECT *, CASE WHEN r1 OR r2 OR r3 THEN 'sparse_history' WHEN r4 OR r5 THEN 'cost_fragility' WHEN r6 OR r7 THEN 'synthetic_fragility' WHEN r8 OR r9 THEN 'weak_signal' ELSE 'none' END AS kind FROM weak0",
    "weak": """SELECT *, kind = 'none' AND NOT r10 AS eligible, concat_ws(',', CASE kind WHEN 'sparse_history' THEN nullif(concat_ws(',', CASE WHEN r1 THEN 'folds_lt_4' END, CASE WHEN r2 THEN 'trades_lt_100' END, CASE WHEN r3 THEN 'row_count_lt_5000' END), '')
      WHEN 'cost_fragility' THEN nullif(concat_ws(',', CASE WHEN r4 THEN 'fees_erase_edge' END, CASE WHEN r5 THEN 'slippage_stress_non_positive' END), '')
      WHEN 'synthetic_fragility' THEN nullif(concat_ws(',', CASE WHEN r6 THEN 'synthetic_dominant_negative' END, CASE WHEN r7 THEN 'synthetic_underperforms_native' END), '')
      WHEN 'weak_signal' THEN nullif(concat_ws(',', CASE WHEN r8 THEN 'net_return_negative' END, CASE WHEN r9 THEN 'roc_auc_lt_0.52' END), '') END, CASE WHEN r10 THEN 'max_drawdown_gt_0.35' END) AS reasons FROM weak1""",
    "gbars": f"SELECT symbol, timestamp_ms, lead(timestamp_ms) OVER (PARTITION BY symbol ORDER BY timestamp_ms) AS nxt FROM fused WHERE timestamp_ms < {ASOF // DAY * DAY}",
    "gparity": "SELECT (SELECT count(*) FROM gbars) = count(*) FILTER (row_status IN ('trainable', 'continuity_only', 'invalid_price', 'unlabeled_missing_horizon')) AS parity FROM snap",
    "gpass": "SELECT avg((eligibility_mode <> 'blocked')::INT) AS pass_rate FROM elig WHERE symbol IN (SELECT symbol FROM snap)",
    "gcover": f"SELECT symbol, coalesce(sum(greatest(0, (nxt - timestamp_ms) // {DAY} - 1)), 0)::BIGINT AS gap_count, round(least(1, count(*) / ((max(timestamp_ms) - min(timestamp_ms)) // {DAY} + 1)), 9) AS coverage_pct FROM gbars GROUP BY 1",
    "gbreach": f"SELECT symbol, CASE WHEN gap_count > {MAX_GAPS} THEN 'combined_gap_count' ELSE 'combined_coverage' END AS gate, CASE WHEN gap_count > {MAX_GAPS} THEN gap_count::DOUBLE ELSE coverage_pct END AS observed, CASE WHEN gap_count > {MAX_GAPS} THEN {MAX_GAPS}::DOUBLE ELSE {MIN_COVERAGE}::DOUBLE END AS required FROM gcover WHERE gap_count > {MAX_GAPS} OR coverage_pct < {MIN_COVERAGE} ORDER BY symbol LIMIT 1",
    "gpreds": "SELECT * FROM preds WHERE scope = 'global'",
    "gtrade": f"SELECT fold, scenario, count(*) AS row_count, count(*) FILTER (probability >= {GATE_TH}) AS trades, coalesce(sum(forward_return) FILTER (probability >= {GATE_TH}), 0) AS gross_return, coalesce(sum(forward_return - 2 * {FEE}::DOUBLE) FILTER (probability >= {GATE_TH}), 0) AS net_return, avg((forward_return - 2 * {FEE}::DOUBLE > 0)::INT) FILTER (probability >= {GATE_TH}) AS win_rate FROM gpreds GROUP BY 1, 2",
    "gcum": f"SELECT fold, scenario, timestamp_ms, symbol, row_key, sum(forward_return - 2 * {FEE}::DOUBLE) OVER (PARTITION BY fold, scenario ORDER BY timestamp_ms, symbol, row_key ROWS UNBOUNDED PRECEDING) AS cum FROM gpreds WHERE probability >= {GATE_TH}",
    "gdraw": "SELECT fold, scenario, max(top - cum) AS max_drawdown FROM (SELECT *, max(cum) OVER (PARTITION BY fold, scenario ORDER BY timestamp_ms, symbol, row_key ROWS UNBOUNDED PRECEDING) AS top FROM gcum) GROUP BY 1, 2",
    "gsum": """SELECT scenario, sum(row_count)::BIGINT AS row_count, sum(trades)::BIGINT AS trades, sum(gross_return) AS gross_return, sum(net_return) AS net_return, avg(win_rate) AS win_rate, avg(coalesce(max_drawdown, 0)) AS max_drawdown,
      avg(logloss) AS logloss, avg(brier) AS brier, avg(roc_auc) AS roc_auc, avg(pr_auc) AS pr_auc, count(*) AS folds FROM gtrade LEFT JOIN gdraw USING (fold, scenario)
      JOIN (SELECT fold, scenario, logloss, brier, roc_auc, pr_auc FROM fmetrics WHERE scope = 'global' AND symbol = '*' AND split = 'all') USING (fold, scenario) GROUP BY 1""",
    "gfacts": "SELECT m.*, (SELECT parity FROM gparity) AS parity, (SELECT pass_rate FROM gpass) AS pass_rate FROM gsum m",
    "gfail": f"""SELECT scenario, x.gate AS gate, x.observed AS observed, x.required AS required FROM (SELECT scenario, unnest([x FOR x IN [
      CASE WHEN folds < 13 THEN {{'gate': 'min_folds', 'observed': folds::DOUBLE, 'required': 13::DOUBLE}} END, CASE WHEN trades < 100 THEN {{'gate': 'min_trades', 'observed': trades::DOUBLE, 'required': 100::DOUBLE}} END,
      CASE WHEN net_return <= 0 THEN {{'gate': 'net_positive', 'observed': net_return, 'required': 0::DOUBLE}} END, CASE WHEN max_drawdown IS NULL OR max_drawdown > 0.35 THEN {{'gate': 'max_drawdown', 'observed': max_drawdown, 'required': 0.35::DOUBLE}} END,
      CASE WHEN net_return - 2 * trades * {SLIP}::DOUBLE <= 0 THEN {{'gate': 'slippage_stress_positive', 'observed': net_return - 2 * trades * {SLIP}::DOUBLE, 'required': 0::DOUBLE}} END,
      CASE WHEN NOT parity THEN {{'gate': 'snapshot_parity', 'observed': 0::DOUBLE, 'required': 1::DOUBLE}} END,
      (SELECT {{'gate': gate, 'observed': observed, 'required': required}} FROM gbreach),
      CASE WHEN scenario <> 'native_only' AND pass_rate < 0.6 THEN {{'gate': 'conversion_pass_rate', 'observed': pass_rate, 'required': 0.6::DOUBLE}} END] IF x IS NOT NULL]) AS x FROM gfacts)""",
    "gchoice": """SELECT scenario, failed FROM (SELECT f.*, coalesce(failed, 0) AS failed FROM gfacts f LEFT JOIN (SELECT scenario, count(*) AS failed FROM gfail GROUP BY 1) USING (scenario)) ORDER BY failed, folds DESC, net_return DESC, coalesce(pr_auc, 0) DESC, scenario DESC LIMIT 1""",
    "cands": f"SELECT * FROM preds WHERE scenario = (SELECT scenario FROM gchoice) AND probability >= {TH}",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY timestamp_ms ORDER BY probability DESC, symbol, row_key) AS rank FROM cands",
    "taken": "SELECT *, 1000 * (1 + forward_return) * (1 - 0.003::DOUBLE) - 1000 * (1 + 0.003::DOUBLE) AS net_pnl FROM ranked WHERE rank <= 2",
    "curve0": f"SELECT timestamp_ms + {2 * DAY} AS exit_ms, sum(net_pnl) AS pnl FROM taken GROUP BY 1",
    "curve1": "SELECT *, 100000 + sum(pnl) OVER (ORDER BY exit_ms ROWS UNBOUNDED PRECEDING) AS equity FROM curve0",
    "curve": "SELECT *, (top - equity) / top AS drawdown_pct FROM (SELECT *, greatest(100000, max(equity) OVER (ORDER BY exit_ms ROWS UNBOUNDED PRECEDING)) AS top FROM curve1)",
}


class Scored:
    """Predictions added up by score, and their trades by time and symbol, each in one pass. Metrics at any of ``thresholds`` come from these."""

    def __init__(self, preds: DataFrame, thresholds: dict[str, float], splits: tuple[str, ...] = ("all",)) -> None:
        self.preds, self.thresholds, self.splits = preds, thresholds, splits

    @cached_property
    def scores(self) -> DataFrame:
        return staged(M.by_score(self.preds, fee=FEE))

    @cached_property
    def runs(self) -> DataFrame:
        return staged(M.trade_runs(self.preds, thresholds=self.thresholds, fee=FEE, order=ORDER, splits=self.splits))

    @cached_property
    def ranks(self) -> DataFrame:
        return staged(M.ranks_of(self.scores, splits=self.splits))

    def metrics(self, name: str, symbols: tuple[str, ...] = M.SYMBOLS) -> DataFrame:
        falls = M.falls_of(self.runs, name, order=ORDER, symbols=symbols, splits=self.splits)
        return M.metrics_of(self.scores, falls, self.ranks, threshold=self.thresholds[name], symbols=symbols, splits=self.splits)


class Evaluation:
    gated = {"gates": GATE_TH}

    def __init__(self, spark, sf: str) -> None:
        self.spark, self.sf = spark, sf

    @cached_property
    def preds(self) -> DataFrame:
        return X.preds(self.spark, self.sf)

    @cached_property
    def grains(self) -> DataFrame:
        return M.splits(self.preds).withColumns({"real_symbol": F.col("symbol"), "symbol": F.explode(F.array(F.col("symbol"), F.lit("*")))})

    @cached_property
    def metrics(self) -> DataFrame:
        return Scored(self.preds, {"entry": TH}, M.SPLITS).metrics("entry")

    @cached_property
    def scored(self) -> Scored:
        """Drawdown and ranking of the split ``all`` alone, which is what summary and attribution read of them."""
        return Scored(self.preds, {"entry": TH})

    @cached_property
    def judged(self) -> Scored:
        return Scored(self.preds.where("scope = 'global'"), self.gated)

    @cached_property
    def summary(self) -> DataFrame:
        return staged(M.summary(self.scored.metrics("entry", ("*",))))

    @cached_property
    def attribution(self) -> DataFrame:
        return I.symbol_attribution(self.scored.metrics("entry", ("own",)), slip=SLIP)

    @cached_property
    def weak(self) -> DataFrame:
        return staged(I.weakness(self.attribution))

    @cached_property
    def facts(self) -> DataFrame:
        """Global metrics at the gates' threshold with the fused snapshot's parity, the share of months that may be trained on by their
        calibrated weights (else by the quality rows), and the first symbol of the fused bars that breaches; each is one row."""
        run = Snapshot(self.spark, self.sf)
        snap = staged(run.rows.select("symbol", "row_status"))
        closed = staged(run.closed)
        parity = S.parity(closed, snap).select("parity")
        quality = run.run.scored.withColumns({"period": F.col("month"), "updated": F.col("venue")})
        rate = C.conversion_pass_rate(run.weights, quality, snap.select("symbol").distinct(), min_rows=MIN_ROWS)
        listed = closed.select("symbol").distinct().select(F.lit("combined").alias("dataset"), "symbol", F.lit(True).alias("has_pair"), F.lit(True).alias("has_file"))
        report = Q.coverage_report(closed.withColumn("dataset", F.lit("combined")), listed, interval_ms=DAY).where("symbol <> '*'")
        breach = I.first_breach(report, max_gaps=MAX_GAPS, min_coverage=MIN_COVERAGE).select("breach")
        out = M.summary(self.judged.metrics("gates", ("*",))).withColumn("_one", F.lit(1))
        for one in (parity, rate, breach):
            out = out.join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one", "left")
        return staged(out.drop("_one"))

    @cached_property
    def failures(self) -> DataFrame:
        return I.gates(self.facts, slip=SLIP, min_folds=13, min_trades=100)

    @cached_property
    def choice(self) -> DataFrame:
        return staged(I.choose(self.facts, self.failures))

    @cached_property
    def candidates(self) -> DataFrame:
        """Of the scenario that the gates choose."""
        return J.candidates(self.preds.join(F.broadcast(self.choice.select("scenario")), "scenario"), threshold=TH)

    @cached_property
    def trades(self) -> DataFrame:
        kept = J.topk_per_bar(self.candidates, k=2, tie=("symbol", "row_key")).where("outcome = 'accepted'")
        return J.trade_pnl(kept, notional=1000.0, cost=0.003)

    @cached_property
    def curve(self) -> DataFrame:
        return J.equity_curve(self.trades, capital=100_000.0, horizon_ms=2 * DAY)


class Promotion(Evaluation):
    """Gates and classes of the global scope, which alone is promoted, from the same two passes over its predictions."""

    gated = {"entry": TH, "gates": GATE_TH}

    @cached_property
    def scored(self) -> Scored:
        return self.judged


KEYS = [*M.KEYS, "symbol", "split"]


def six(df: DataFrame, *names: str) -> DataFrame:
    """Six places; the nudge settles ties that sums in another order would break either way (so does ``nudged`` in SQL)."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def nudged(sql: str) -> str:
    return sql.replace(", 6)", " + 1e-9, 6)")


@query(f"SELECT {G}, row_count, trades, round(gross_return, 6) AS gross_return, round(net_return, 6) AS net_return, round(win_rate, 6) AS win_rate FROM mtrade")
def metric_trades(spark, sf):
    return six(M.trading(Evaluation(spark, sf).grains, KEYS, threshold=TH, fee=FEE), "gross_return", "net_return", "win_rate")


@query(f"SELECT {G}, round(coalesce(max_drawdown, 0), 6) AS max_drawdown FROM mtrade LEFT JOIN mdraw USING ({G})")
def metric_drawdown(spark, sf):
    return six(M.drawdown(Evaluation(spark, sf).grains, KEYS, ["timestamp_ms", "real_symbol", "row_key"], threshold=TH, fee=FEE), "max_drawdown")


@query(f"SELECT {G}, round(logloss, 6) AS logloss, round(brier, 6) AS brier FROM mloss")
def metric_probloss(spark, sf):
    return six(M.probability_loss(Evaluation(spark, sf).grains, KEYS), "logloss", "brier")


@query(f"SELECT {G}, round(roc_auc, 6) AS roc_auc FROM mrank")
def metric_auc(spark, sf):
    return six(M.ranking(Evaluation(spark, sf).grains, KEYS).drop("pr_auc"), "roc_auc")


@query(f"SELECT {G}, round(pr_auc, 6) AS pr_auc FROM mrank")
def metric_ap(spark, sf):
    return six(M.ranking(Evaluation(spark, sf).grains, KEYS).drop("roc_auc"), "pr_auc")


FLOATS = ("gross_return", "net_return", "win_rate", "max_drawdown", "logloss", "brier", "roc_auc", "pr_auc")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in FLOATS)


@query(f"SELECT {G}, row_count, trades, {ROUNDED} FROM fmetrics")
def fold_metrics(spark, sf):
    return six(Evaluation(spark, sf).metrics, *FLOATS)


@query(f"SELECT scenario, scope, row_count, trades, folds, {ROUNDED} FROM msum")
def metric_summary(spark, sf):
    return six(Evaluation(spark, sf).summary, *FLOATS)


@query("SELECT scenario AS primary_scenario FROM msum WHERE scope = 'global' ORDER BY net_return DESC, pr_auc DESC, scenario DESC LIMIT 1")
def primary_scenario(spark, sf):
    return M.primary_scenario(Evaluation(spark, sf).summary)


@query("SELECT scenario, scope, symbol, folds, row_count, trades, synthetic_rows, round(gross_return, 6) AS gross_return, round(net_return, 6) AS net_return, round(native_net, 6) AS native_net, round(synthetic_net, 6) AS synthetic_net, round(roc_auc, 6) AS roc_auc, round(max_drawdown, 6) AS max_drawdown, round(synthetic_share, 6) AS synthetic_share, round(stressed_net, 6) AS stressed_net FROM attr")
def symbol_attribution(spark, sf):
    return six(Evaluation(spark, sf).attribution, "gross_return", "net_return", "native_net", "synthetic_net", "roc_auc", "max_drawdown", "synthetic_share", "stressed_net")


@query("SELECT scenario, scope, symbol, kind, reasons, eligible FROM weak")
def weakness_class(spark, sf):
    return Evaluation(spark, sf).weak.select("scenario", "scope", "symbol", "kind", "reasons", "eligible")


@query("SELECT scenario, scope, symbol, rank, round(stressed_net, 6) AS stressed_net FROM (SELECT *, row_number() OVER (PARTITION BY scenario, scope ORDER BY stressed_net, net_return, symbol) AS rank FROM attr) WHERE rank <= 10")
def worst_symbols(spark, sf):
    rows = I.worst_symbols(Evaluation(spark, sf).attribution).select("scenario", "scope", "symbol", F.col("rank").cast("bigint").alias("rank"), "stressed_net")
    return six(rows, "stressed_net")


@query(f"SELECT scenario, folds, trades, {ROUNDED} FROM gfacts")
def gate_metrics(spark, sf):
    return six(Evaluation(spark, sf).facts.select("scenario", "folds", "trades", *FLOATS), *FLOATS)


@query("SELECT scenario, gate, round(observed, 6) AS observed, required FROM gfail UNION ALL SELECT scenario, NULL, NULL, NULL FROM gfacts WHERE scenario NOT IN (SELECT scenario FROM gfail)")
def promotion_gates(spark, sf):
    return six(Evaluation(spark, sf).failures, "observed")


@query("SELECT scenario, failed FROM gchoice")
def promotion_choice(spark, sf):
    return Evaluation(spark, sf).choice


@query("""SELECT 'decision' AS type, scenario, CASE WHEN failed = 0 THEN 'accepted' ELSE 'rejected' END AS detail FROM gchoice
  UNION ALL SELECT 'omitted', scenario, symbol FROM weak WHERE scope = 'global' AND NOT eligible AND scenario IN (SELECT scenario FROM gchoice)
  UNION ALL SELECT 'worst', scenario, symbol FROM (SELECT *, row_number() OVER (PARTITION BY scenario, scope ORDER BY stressed_net, net_return, symbol) AS rk FROM weak WHERE scope = 'global' AND scenario IN (SELECT scenario FROM gchoice)) WHERE rk <= 5
  UNION ALL SELECT 'alternative', scenario, gate FROM gfail WHERE scenario NOT IN (SELECT scenario FROM gchoice)""")
def promotion_record(spark, sf):
    run = Promotion(spark, sf)
    return I.promotion_record(run.choice, run.weak, run.failures)


@query("SELECT symbol, timestamp_ms, probability, row_key FROM cands")
def trade_candidates(spark, sf):
    return Evaluation(spark, sf).candidates.select("symbol", "timestamp_ms", "probability", "row_key")


@query("SELECT row_key, timestamp_ms, symbol, rank, CASE WHEN rank <= 2 THEN 'accepted' ELSE 'capacity' END AS outcome FROM ranked")
def topk_per_bar(spark, sf):
    rows = J.topk_per_bar(Evaluation(spark, sf).candidates, k=2, tie=("symbol", "row_key"))
    return rows.select("row_key", "timestamp_ms", "symbol", F.col("rank").cast("bigint").alias("rank"), "outcome")


VIEWS |= {
    "ctimes": "SELECT symbol, timestamp_ms, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms) AS n FROM (SELECT DISTINCT symbol, timestamp_ms FROM cands)",
    "holds": f"""SELECT symbol, n, timestamp_ms, timestamp_ms AS last_ms, true AS ok FROM ctimes WHERE n = 1 UNION ALL SELECT c.symbol, c.n, c.timestamp_ms,
      CASE WHEN c.timestamp_ms >= h.last_ms + {5 * DAY} THEN c.timestamp_ms ELSE h.last_ms END, c.timestamp_ms >= h.last_ms + {5 * DAY} FROM holds h JOIN ctimes c ON c.symbol = h.symbol AND c.n = h.n + 1""",
}


@query("SELECT symbol, timestamp_ms FROM holds WHERE ok")
def non_overlap(spark, sf):
    return J.non_overlapping(Evaluation(spark, sf).candidates, horizon_ms=5 * DAY)


@query("SELECT row_key, symbol, timestamp_ms, round(1000 * forward_return, 6) AS gross_pnl, round(net_pnl, 6) AS net_pnl, round(net_pnl / (1000 * (1 + 0.003::DOUBLE)), 6) AS net_pct FROM taken")
def trade_pnl(spark, sf):
    return six(Evaluation(spark, sf).trades.select("row_key", "symbol", "timestamp_ms", "gross_pnl", "net_pnl", "net_pct"), "gross_pnl", "net_pnl", "net_pct")


@query("SELECT exit_ms, round(pnl, 6) AS pnl, round(equity, 6) AS equity, round(drawdown_pct, 6) AS drawdown_pct FROM curve")
def equity_curve(spark, sf):
    return six(Evaluation(spark, sf).curve, "pnl", "equity", "drawdown_pct")


@query("""SELECT month, round(equity, 6) AS equity, round(equity / coalesce(lag(equity) OVER (ORDER BY month), 100000) - 1, 6) AS monthly_return FROM (SELECT strftime(epoch_ms(exit_ms), '%Y-%m') AS month, arg_max(equity, exit_ms) AS equity FROM curve GROUP BY 1)""")
def monthly_returns(spark, sf):
    return six(J.monthly_returns(Evaluation(spark, sf).curve, capital=100_000.0), "equity", "monthly_return")


@query(f"""SELECT trades, round(net_pnl, 6) AS net_pnl, round(win_rate, 6) AS win_rate, round(equity, 6) AS equity, round(max_drawdown_pct, 6) AS max_drawdown_pct, round(CASE WHEN span >= {DAY} AND equity > 0 THEN pow(equity / 100000, {J.YEAR_MS}::DOUBLE / span) - 1 END, 6) AS annualized_return
  FROM (SELECT count(*) AS trades, sum(net_pnl) AS net_pnl, avg((net_pnl > 0)::INT) AS win_rate FROM taken), (SELECT arg_max(equity, exit_ms) AS equity, max(drawdown_pct) AS max_drawdown_pct, max(exit_ms) - min(exit_ms) AS span FROM curve)""")
def trade_summary(spark, sf):
    run = Evaluation(spark, sf)
    return six(J.trade_summary(run.trades, run.curve, capital=100_000.0), "net_pnl", "win_rate", "equity", "max_drawdown_pct", "annualized_return")


@query("""SELECT symbol, source, count(*) AS trades, round(sum(net_pnl), 6) AS net_pnl, round(avg(net_pnl), 6) AS avg_pnl, round(avg((net_pnl > 0)::INT), 6) AS win_rate
  FROM (SELECT symbol, '*' AS source, net_pnl FROM taken UNION ALL SELECT '*', source, net_pnl FROM taken) GROUP BY 1, 2""")
def pnl_breakdown(spark, sf):
    return six(J.pnl_breakdown(Evaluation(spark, sf).trades), "net_pnl", "avg_pnl", "win_rate")


CONFIGS = [(0.5, 1, 0.002, 0), (0.6, 2, 0.003, 0), (0.8, 5, 0.001, 0), (0.6, 2, 0.003, 5 * DAY)]

VIEWS |= {
    "scfg": f"SELECT * FROM (VALUES {', '.join(f'({i}, {t}::DOUBLE, {k}, {c}::DOUBLE, {h}::BIGINT)' for i, (t, k, c, h) in enumerate(CONFIGS))}) v(config, threshold, k, cost, hold_ms)",
    "scand": "SELECT c.*, symbol, timestamp_ms, row_key, probability, forward_return FROM preds p, scfg c WHERE probability >= threshold",
    "stimes": "SELECT config, hold_ms, symbol, timestamp_ms, row_number() OVER (PARTITION BY config, symbol ORDER BY timestamp_ms) AS n FROM (SELECT DISTINCT config, hold_ms, symbol, timestamp_ms FROM scand WHERE hold_ms > 0)",
    "sholds": """SELECT config, hold_ms, symbol, n, timestamp_ms, timestamp_ms AS last_ms, true AS ok FROM stimes WHERE n = 1 UNION ALL SELECT c.config, c.hold_ms, c.symbol, c.n, c.timestamp_ms,
      CASE WHEN c.timestamp_ms >= h.last_ms + c.hold_ms THEN c.timestamp_ms ELSE h.last_ms END, c.timestamp_ms >= h.last_ms + c.hold_ms FROM sholds h JOIN stimes c ON c.config = h.config AND c.symbol = h.symbol AND c.n = h.n + 1""",
    "sopen": "SELECT c.* FROM scand c WHERE hold_ms = 0 OR EXISTS (SELECT 1 FROM sholds h WHERE h.ok AND h.config = c.config AND h.symbol = c.symbol AND h.timestamp_ms = c.timestamp_ms)",
    "srank": "SELECT *, row_number() OVER (PARTITION BY config, timestamp_ms ORDER BY probability DESC, symbol, row_key) AS r FROM sopen",
    "strade": "SELECT *, 1000 * (1 + forward_return) * (1 - cost) - 1000 * (1 + cost) AS pnl FROM srank WHERE r <= k",
    "scurve0": f"SELECT config, timestamp_ms + {2 * DAY} AS exit_ms, sum(pnl) AS pnl FROM strade GROUP BY 1, 2",
    "scurve1": "SELECT *, 100000 + sum(pnl) OVER (PARTITION BY config ORDER BY exit_ms ROWS UNBOUNDED PRECEDING) AS equity FROM scurve0",
    "scurve": "SELECT *, (top - equity) / top AS drawdown_pct FROM (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY config ORDER BY exit_ms ROWS UNBOUNDED PRECEDING)) AS top FROM scurve1)",
}


@query(f"""SELECT config, threshold, k, cost, hold_ms, trades, round(net_pnl, 6) AS net_pnl, round(win_rate, 6) AS win_rate, round(equity, 6) AS equity, round(max_drawdown_pct, 6) AS max_drawdown_pct,
  round(CASE WHEN span >= {DAY} AND equity > 0 THEN pow(equity / 100000, {J.YEAR_MS}::DOUBLE / span) - 1 END, 6) AS annualized_return
  FROM (SELECT config, threshold, k, cost, hold_ms, count(*) AS trades, sum(pnl) AS net_pnl, avg((pnl > 0)::INT) AS win_rate FROM strade GROUP BY ALL)
  JOIN (SELECT config, arg_max(equity, exit_ms) AS equity, max(drawdown_pct) AS max_drawdown_pct, max(exit_ms) - min(exit_ms) AS span FROM scurve GROUP BY 1) USING (config)""")
def param_sweep(spark, sf):
    out = J.sweep(staged(Evaluation(spark, sf).preds), CONFIGS, notional=1000.0, capital=100_000.0, horizon_ms=2 * DAY)
    return six(out, "net_pnl", "win_rate", "equity", "max_drawdown_pct", "annualized_return")


for _name, _f in list(QUERIES.items()):
    if _f.__module__ == __name__ and _name in ORACLES:
        ORACLES[_name] = nudged(ORACLES[_name])
