"""Labelled snapshots of the fused bars."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import snapshot as S
from ..sources import fixtures as X
from ..sources.staging import staged
from . import VIEWS, query
from .fusion import Fusion

DAY, H, FEE = X.DAY, 2, 0.002
ASOF = 946_684_800_000 + 3_600_000  # 2000-01-01 01:00

W = "(PARTITION BY symbol ORDER BY timestamp_ms)"
VIEWS |= {
    "labelled": f"""SELECT *, CASE WHEN close > 0 THEN next_close / close - 1 END AS forward_return, CASE WHEN close > 0 AND next_close IS NOT NULL THEN (next_close / close - 1 > 2 * {FEE}::DOUBLE)::TINYINT END AS y FROM (
      SELECT *, lead(timestamp_ms) OVER {W} AS next_timestamp_ms, CASE WHEN lead(timestamp_ms, {H}) OVER {W} = timestamp_ms + {H * DAY} THEN lead(close, {H}) OVER {W} END AS next_close,
      max((source LIKE '%_fill')::INT) OVER (PARTITION BY symbol ORDER BY timestamp_ms ROWS BETWEEN CURRENT ROW AND {H} FOLLOWING) = 1 AS fill_in_horizon FROM fused WHERE timestamp_ms < {ASOF // DAY * DAY})""",
    "weighted": """SELECT l.*, strftime(epoch_ms(timestamp_ms), '%Y-%m') AS effective_month, source = 'native' OR coalesce(eligibility_mode <> 'blocked', false) AS quality_pass,
      CASE WHEN source = 'native' THEN 1.0 ELSE weight_final END AS effective_monthly_weight FROM labelled l LEFT JOIN elig e ON e.symbol = l.symbol AND e.month = strftime(epoch_ms(timestamp_ms), '%Y-%m')""",
    "snap": f"""SELECT *, {DAY // 1000}::INT AS interval_seconds, 0::DOUBLE AS inside_bid, 0::DOUBLE AS inside_ask, CASE WHEN source = 'native' THEN 'native' ELSE 'monthly' END AS weight_method_version, next_close IS NOT NULL AS label_available, CASE WHEN row_status = 'trainable' THEN effective_monthly_weight ELSE 0 END AS supervised_row_weight FROM (SELECT *, CASE WHEN next_close IS NULL THEN 'unlabeled_missing_horizon'
      WHEN close <= 0 THEN 'invalid_price' WHEN fill_in_horizon THEN 'continuity_only' WHEN source <> 'native' AND NOT quality_pass THEN 'continuity_only' ELSE 'trainable' END AS row_status FROM weighted)""",
}


class Snapshot:
    def __init__(self, spark, sf: str) -> None:
        self.run = Fusion(spark, sf)

    @cached_property
    def fused(self) -> DataFrame:
        return staged(self.run.fused)

    @cached_property
    def closed(self) -> DataFrame:
        return S.closed_cutoff(self.fused, asof_ms=ASOF, interval_ms=DAY)

    @cached_property
    def weights(self) -> DataFrame:
        return staged(self.run.eligible.select("symbol", "month", "weight_final", "supervised_eligible"))

    @cached_property
    def rows(self) -> DataFrame:
        return S.build(self.closed, self.weights, horizon=H, interval_ms=DAY, fee=FEE)


@query(f"SELECT symbol, timestamp_ms, close FROM fused WHERE timestamp_ms < {ASOF // DAY * DAY}")
def closed_cutoff(spark, sf):
    return Snapshot(spark, sf).closed.select("symbol", "timestamp_ms", "close")


@query(f"""SELECT symbol, CASE WHEN symbol = 'S3' THEN 'excluded_symbol' WHEN symbol NOT IN (SELECT symbol FROM vbars) THEN 'missing_dataset_file'
  WHEN symbol NOT IN (SELECT symbol FROM vbars WHERE timestamp_ms < {ASOF // DAY * DAY}) THEN 'no_closed_rows_before_asof' END AS reason FROM (SELECT DISTINCT symbol FROM vbars UNION ALL SELECT 'S8')""")
def snapshot_universe(spark, sf):
    bars = X.vbars(spark, sf).select("symbol", "timestamp_ms")
    symbols = bars.select("symbol").distinct()
    universe = symbols.unionByName(symbols.limit(1).select(F.lit("S8").alias("symbol")))
    return S.universe_reasons(universe, bars, S.closed_cutoff(bars, asof_ms=ASOF, interval_ms=DAY), ["S3"])


@query("SELECT symbol, timestamp_ms, next_timestamp_ms, next_close, forward_return, y FROM labelled")
def horizon_label(spark, sf):
    rows = S.horizon_label(Snapshot(spark, sf).closed, horizon=H, interval_ms=DAY, fee=FEE)
    return rows.select("symbol", "timestamp_ms", "next_timestamp_ms", "next_close", "forward_return", "y")


@query("SELECT symbol, timestamp_ms, effective_month, quality_pass, round(effective_monthly_weight, 9) AS effective_monthly_weight FROM weighted")
def weight_lookup(spark, sf):
    run = Snapshot(spark, sf)
    return S.with_weights(run.closed, run.weights).select("symbol", "timestamp_ms", "effective_month", "quality_pass", F.round("effective_monthly_weight", 9).alias("effective_monthly_weight"))


@query("SELECT symbol, timestamp_ms, row_status FROM snap")
def row_status(spark, sf):
    return Snapshot(spark, sf).rows.select("symbol", "timestamp_ms", "row_status")


COLUMNS = S.COLUMNS
WEIGHTS = ("effective_monthly_weight", "supervised_row_weight")


@query(f"SELECT {', '.join(f'round({c}, 9) AS {c}' if c in WEIGHTS else c for c in COLUMNS)} FROM snap")
def snapshot_rows(spark, sf):
    return Snapshot(spark, sf).rows.select(*(F.round(c, 9).alias(c) if c in WEIGHTS else c for c in COLUMNS))


@query("""SELECT symbol, count(*) AS rows, count(*) FILTER (row_status = 'trainable') AS trainable_rows, count(*) FILTER (row_status = 'continuity_only') AS continuity_rows,
  count(*) FILTER (row_status LIKE 'unlabeled%') AS unlabeled_rows, count(*) FILTER (source = 'native') AS native_rows, round(sum(supervised_row_weight), 6) AS weight_sum, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts
  FROM (SELECT * FROM snap UNION ALL SELECT * REPLACE ('*' AS symbol) FROM snap) GROUP BY symbol""")
def snapshot_manifest(spark, sf):
    return S.manifest(Snapshot(spark, sf).rows)


@query(f"SELECT count(*) AS input_rows, (SELECT count(*) FROM snap) AS output_rows, (SELECT count(*) FROM snap) AS status_rows, count(*) = (SELECT count(*) FROM snap) AS parity FROM fused WHERE timestamp_ms < {ASOF // DAY * DAY}")
def snapshot_parity(spark, sf):
    run = Snapshot(spark, sf)
    return S.parity(run.closed, run.rows)


@query("""SELECT symbol, effective_month, count(*) AS rows, count(*) FILTER (row_status = 'trainable') AS trainable_rows, count(*) FILTER (row_status = 'continuity_only') AS continuity_rows
  FROM snap WHERE source <> 'native' GROUP BY 1, 2""")
def weight_usage(spark, sf):
    return S.weight_usage(Snapshot(spark, sf).rows)
