"""Folds, scenarios, training and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds as H
from ..operators import learn
from ..sources import fixtures as X
from ..sources.staging import stage_folder, staged
from . import VIEWS, query

DAY = X.DAY
T, V, S, N = 12, 1, 1, 6

VIEWS |= {
    "edges": "SELECT date_trunc('month', epoch_ms(min(timestamp_ms)))::DATE AS ma, date_trunc('month', epoch_ms(max(timestamp_ms)))::DATE AS mb, min(timestamp_ms) AS a, max(timestamp_ms) AS b FROM vbars",
    "fmonths": f"""SELECT strftime(m, '%Y-%m') AS month FROM (SELECT CASE WHEN epoch_ms(ma) = a THEN ma ELSE (ma + INTERVAL 1 MONTH)::DATE END AS f,
      CASE WHEN b >= epoch_ms((mb + INTERVAL 1 MONTH)::DATE) - {DAY} THEN mb ELSE (mb - INTERVAL 1 MONTH)::DATE END AS l FROM edges), unnest(generate_series(f, l, INTERVAL 1 MONTH)) AS t(m)""",
    "mspan": f"SELECT min(month) AS first, count(*) AS n, (count(*) - {T + V}) // {S} + 1 AS total FROM fmonths",
    "wfolds": f"""SELECT (k - greatest(total - {N}, 0) + 1)::INT AS fold_index, strftime((first || '-01')::DATE + to_months((k * {S})::INT), '%Y-%m') AS train_start, strftime((first || '-01')::DATE + to_months((k * {S} + {T - 1})::INT), '%Y-%m') AS train_end,
      strftime((first || '-01')::DATE + to_months((k * {S} + {T})::INT), '%Y-%m') AS valid_start, strftime((first || '-01')::DATE + to_months((k * {S} + {T + V - 1})::INT), '%Y-%m') AS valid_end FROM mspan, unnest(range(0, total)) AS t(k) WHERE n >= {T + V} AND k >= total - {N}""",
    "lrows": """SELECT symbol, timestamp_ms, CASE WHEN venue = 'native' THEN 'native' WHEN source LIKE '%_fill' THEN 'synthetic_fill' ELSE 'synthetic' END AS source, (close > open)::INT AS y, venue FROM vbars""",
    "assigned": """SELECT l.*, strftime(epoch_ms(timestamp_ms), '%Y-%m') AS month, fold_index, CASE WHEN strftime(epoch_ms(timestamp_ms), '%Y-%m') <= train_end THEN 'train' ELSE 'valid' END AS role
      FROM lrows l JOIN wfolds f ON strftime(epoch_ms(timestamp_ms), '%Y-%m') BETWEEN train_start AND valid_end""",
    "scen": "SELECT *, 'weighted' AS scenario FROM assigned UNION ALL SELECT *, 'native_only' FROM assigned WHERE source = 'native'",
    "reasons": """SELECT *, CASE WHEN train_rows = 0 THEN 'train has no rows' WHEN valid_rows = 0 THEN 'valid has no rows'
      WHEN len(tl) <> 2 THEN 'train must contain both classes, observed=[' || array_to_string(tl, ', ') || ']' WHEN len(vl) <> 2 THEN 'valid must contain both classes, observed=[' || array_to_string(vl, ', ') || ']' END AS reason
      FROM (SELECT fold_index, scenario, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'valid') AS valid_rows,
      list_sort(coalesce(list(DISTINCT y) FILTER (role = 'train'), [])) AS tl, list_sort(coalesce(list(DISTINCT y) FILTER (role = 'valid'), [])) AS vl FROM scen GROUP BY 1, 2)""",
    "symbol_reasons": """SELECT *, CASE WHEN train_rows < 1000 THEN 'train_rows_lt_1000' WHEN valid_rows < 100 THEN 'valid_rows_lt_100' WHEN tn <> 2 THEN 'train_missing_class' WHEN vn <> 2 THEN 'valid_missing_class' END AS reason
      FROM (SELECT fold_index, scenario, symbol, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'valid') AS valid_rows,
      count(DISTINCT y) FILTER (role = 'train') AS tn, count(DISTINCT y) FILTER (role = 'valid') AS vn FROM scen GROUP BY 1, 2, 3)""",
}


def rows(spark, sf) -> DataFrame:
    tag = F.expr("case when venue = 'native' then 'native' when source like '%_fill' then 'synthetic_fill' else 'synthetic' end")
    return X.vbars(spark, sf).select("symbol", "timestamp_ms", tag.alias("source"), (F.col("close") > F.col("open")).cast("int").alias("y"), "venue")


def folds(spark, sf) -> DataFrame:
    return H.walk_forward_folds(H.full_months(rows(spark, sf), interval_ms=DAY), train=T, valid=V, step=S, last=N)


def assigned(spark, sf) -> DataFrame:
    return H.assign(rows(spark, sf), folds(spark, sf))


@query("SELECT * FROM fmonths")
def full_months(spark, sf):
    return H.full_months(rows(spark, sf), interval_ms=DAY)


@query("SELECT * FROM wfolds")
def walk_forward_folds(spark, sf):
    return folds(spark, sf)


@query("SELECT fold_index, role, symbol, venue, timestamp_ms FROM assigned")
def fold_assign(spark, sf):
    return assigned(spark, sf).select("fold_index", "role", "symbol", "venue", "timestamp_ms")


@query("SELECT scenario, fold_index, role, count(*) AS rows FROM scen GROUP BY 1, 2, 3")
def scenario_rows(spark, sf):
    return H.scenarios(assigned(spark, sf)).groupBy("scenario", "fold_index", "role").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT fold_index, scenario, train_rows, valid_rows, reason FROM reasons")
def skip_reasons(spark, sf):
    return H.skip_reasons(H.scenarios(assigned(spark, sf)), ("fold_index", "scenario"))


@query("SELECT fold_index, scenario, symbol, train_rows, valid_rows, reason FROM symbol_reasons")
def symbol_skip_reasons(spark, sf):
    return H.skip_reasons(H.scenarios(assigned(spark, sf)), ("fold_index", "scenario", "symbol"))


@query(
    "SELECT fold_index, "
    + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}_rows" for r in ("train", "valid"))
    + ", "
    + ", ".join(f"count(*) FILTER (role = '{r}' AND source = '{s}') AS {r}_{s}" for r in ("train", "valid") for s in ("native", "synthetic", "synthetic_fill"))
    + " FROM assigned GROUP BY 1"
)
def fold_audit(spark, sf):
    return H.fold_audit(assigned(spark, sf))


@query("SELECT *, CASE WHEN completed = folds THEN 'trained' WHEN completed > 0 THEN 'partial' ELSE 'skipped' END AS status FROM (SELECT scenario, count(*) AS folds, count(*) FILTER (reason IS NULL) AS completed FROM reasons GROUP BY 1)")
def scenario_status(spark, sf):
    return H.scenario_status(skip_reasons(spark, sf))


@query("""SELECT fold, symbol, timestamp_ms, round(CASE WHEN count(s) OVER (PARTITION BY symbol) >= 100 AND s IS NOT NULL AND g IS NOT NULL THEN 0.7 * s + (1 - 0.7) * g ELSE coalesce(g, s) END, 9) AS score FROM
  (SELECT fold, symbol, timestamp_ms, avg(probability) FILTER (scope = 'global') AS g, avg(probability) FILTER (scope = 'symbol') AS s FROM preds GROUP BY 1, 2, 3)""")
def blend_score(spark, sf):
    return H.blend(X.preds(spark, sf), keys=["fold", "symbol", "timestamp_ms"], enough=100).withColumn("score", F.round("score", 9))


def trained(spark, sf, *, last: int, trees: int, folder: str) -> DataFrame:
    """Walk-forward predictions on all features of the fused snapshot, rows weighted by their calibrated weight."""
    from . import features as P

    features = P.WHOLE
    made = P.snapshot_table(spark, sf)
    ready = staged(made.select("symbol", "timestamp_ms", "source", "forward_return", F.col("y").cast("int").alias("y"), "supervised_row_weight", *(F.col(n).cast("double").alias(n) for n in features)))
    chosen = H.walk_forward_folds(H.full_months(ready, interval_ms=DAY), train=T, valid=V, step=S, last=last)
    return learn.walk_forward(H.scenarios(H.assign(ready, chosen)), list(features), weight="supervised_row_weight", run_id="wf", snapshot_id="fused", trees=trees, folder=folder)


@query()
def wf_train_predict(spark, sf):
    """Every fold, both scenarios, the global model and the eligible symbols' own ones, on the whole feature table."""
    return trained(spark, sf, last=N, trees=20, folder=stage_folder(spark))


CHAIN_TH, CHAIN_FEE, CHAIN_K, CHAIN_CAPITAL = 0.55, 0.002, 2, 100_000.0


@query()
def training_chain(spark, sf):
    """From the snapshot to trades: train, write predictions, scan them, metrics, gates, choice, trades of the chosen scenario.

    One row for each figure: ``part`` (metrics, gate, choice, trades), ``scenario``, ``name``, ``value``.
    """
    from ..operators import attribution as I
    from ..operators import metrics as M
    from ..operators import trades as J

    folder = stage_folder(spark)
    trained(spark, sf, last=2, trees=5, folder=folder)
    return chain_results(spark, [f"{folder}/predictions"], M, I, J)


def chain_results(spark, paths: list[str], M, I, J) -> DataFrame:  # noqa: E741, N803
    from ..sources import tables as A

    preds = {s: staged(A.prediction_scan(spark, paths, scenario=s).withColumn("row_key", F.concat_ws(":", "symbol", "timestamp_ms"))) for s in ("weighted", "native_only")}
    both = preds["weighted"].unionByName(preds["native_only"])
    metrics = staged(M.fold_metrics(both, threshold=CHAIN_TH, fee=CHAIN_FEE, order=["timestamp_ms", "symbol"]))
    whole = staged(M.summary(metrics))
    # The snapshot's facts are gates of their own queries; here nothing but the predictions decides.
    none = {"parity": F.lit(True), "pass_rate": F.lit(1.0), "breach": F.lit(None).cast("struct<gate:string,observed:double,required:double>")}
    facts = staged(whole.withColumns(none))
    failures = staged(I.gates(facts, slip=0.001, min_folds=2, min_trades=100))
    choice = staged(I.choose(facts, failures))
    picked = J.topk_per_bar(J.candidates(both.join(F.broadcast(choice.select("scenario")), "scenario"), threshold=CHAIN_TH), k=CHAIN_K).where("outcome = 'accepted'")
    trades = staged(J.trade_pnl(picked, notional=1000.0, cost=CHAIN_FEE))
    summary = J.trade_summary(trades, J.equity_curve(trades, capital=CHAIN_CAPITAL, horizon_ms=2 * DAY), capital=CHAIN_CAPITAL)

    def long(df: DataFrame, part: str, scenario, names: tuple[str, ...]) -> DataFrame:
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names)))
        return df.select(F.lit(part).alias("part"), scenario.alias("scenario"), cells.alias("c")).select("part", "scenario", "c.*")

    rows = long(whole.where("scope = 'global'"), "metrics", F.col("scenario"), ("folds", "row_count", "trades", "gross_return", "net_return", "max_drawdown", "roc_auc", "pr_auc"))
    rows = rows.unionByName(failures.select(F.lit("gate").alias("part"), "scenario", F.col("gate").alias("name"), F.col("observed").cast("double").alias("value")))
    rows = rows.unionByName(long(choice, "choice", F.col("scenario"), ("failed",)))
    return rows.unionByName(long(summary, "trades", F.lit(None).cast("string"), ("trades", "net_pnl", "equity", "max_drawdown_pct")))
