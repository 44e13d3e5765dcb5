"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from barflow import registry

SF = "/root/testdata/sf0.001"
NAMES = [
    "ohlcv_bars", "lenient_scan", "gap_repair", "coverage_report", "missing_windows", "universe_resolve", "pair_resolve", "quote_suffix", "overlap_obs", "conversion_context", "asof_nearest",
    "combined_bars", "calibrate_weights", "snapshot_rows", "feat_rsi", "feat_zscore", "feat_ema", "fold_assign", "skip_reasons", "fold_metrics", "promotion_record", "param_sweep",
    "indicator_snapshot", "decisions", "position_replay", "reconcile", "cash_cap", "gate_metrics", "error_streaks", "fill_normalize",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall())
    assert len(got) > 0 and got == want


def test_every_query_is_registered_once_with_sql_or_a_reason():
    rows_only = {"content_hash", "tick_csv_scan", "wf_train_predict", "stream_bars", "stream_dedup", "stream_sessions", "stream_late_repair", "stream_late_bars", "training_chain", "stream_coverage", "stream_indicators"}
    assert set(registry.queries()) - set(registry.oracle_sql()) == rows_only
