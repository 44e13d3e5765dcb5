"""Scans, bars and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import quality as Q
from ..sources import fixtures as X
from ..sources import tables as A
from ..sources.staging import stage_folder
from . import VIEWS, query

HOUR, DAY, T0, T1 = X.HOUR, X.DAY, X.TICKS_FROM, X.TICKS_TO
V0, V1 = 788_918_400_000, 1_009_843_200_000  # 1995-01-01 .. 2002-01-01

VIEWS |= {
    "tbars": f"""SELECT symbol, (ts_ms // {HOUR} + 1) * {HOUR} AS timestamp_ms, first(price ORDER BY ts_ms, seq) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY ts_ms, seq) AS close, sum(volume) AS volume FROM ticks WHERE volume >= 0 AND ts_ms >= {T0} AND ts_ms < {T1} AND (ts_ms // {HOUR} + 1) * {HOUR} < {T1} GROUP BY ALL""",
    "tgaps": "SELECT symbol, timestamp_ms, close, lead(timestamp_ms) OVER (PARTITION BY symbol ORDER BY timestamp_ms) AS nxt FROM tbars",
    "tfull": f"""SELECT symbol, timestamp_ms, open, high, low, close, volume, 'native' AS source FROM tbars
      UNION ALL SELECT symbol, unnest(range(timestamp_ms + {HOUR}, nxt, {HOUR})), close, close, close, close, 0, 'native_fill' FROM tgaps WHERE nxt - timestamp_ms > {HOUR} AND close > 0""",
    "dupbars": f"SELECT 'S' || (l_suppkey % 4) AS symbol, epoch_ms(l_shipdate) + (l_partkey % 10 = 0)::INT * 5 AS timestamp_ms FROM lineitem",
}


def tick_bars(spark, sf) -> DataFrame:
    return B.ohlcv_bars(X.ticks(spark, sf), interval_ms=HOUR, start_ms=T0, end_ms=T1)


def full_tick_bars(spark, sf) -> DataFrame:
    return B.repair_gaps(tick_bars(spark, sf).withColumn("source", F.lit("native")), interval_ms=HOUR, source="native_fill")


@query("SELECT symbol, timestamp_ms, open, high, low, close, volume FROM tbars")
def ohlcv_bars(spark, sf):
    return tick_bars(spark, sf)


VIEWS["rawbars"] = """SELECT CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 's' || (l_suppkey % 4) END AS symbol,
  CASE WHEN l_orderkey % 17 = 0 THEN 'bad' ELSE (epoch_ms(l_shipdate) // 86400000 * 86400000)::VARCHAR END AS timestamp_ms,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS open, l_quantity AS close, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE ' EXT_A ' END AS source,
  concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, lpad(l_partkey::VARCHAR, 12, '0'), lpad(l_suppkey::VARCHAR, 8, '0'), lpad(l_quantity::BIGINT::VARCHAR, 6, '0')) AS seq FROM lineitem"""


@query(
    """SELECT symbol, timestamp_ms, open, 0::DOUBLE AS high, close, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp_ms ORDER BY seq DESC) AS rn FROM (
      SELECT upper(coalesce(nullif(trim(symbol), ''), 'fallback')) AS symbol, try_cast(timestamp_ms AS BIGINT) AS timestamp_ms, coalesce(open, 0) AS open, coalesce(close, 0) AS close,
      lower(coalesce(nullif(trim(source), ''), 'native')) AS source, seq FROM rawbars) WHERE timestamp_ms IS NOT NULL) WHERE rn = 1"""
)
def lenient_scan(spark, sf):
    raw = A.read_table(spark, sf, "lineitem").selectExpr(
        "if(l_linenumber % 3 = 0, ' ', concat('s', l_suppkey % 4)) as symbol",
        "if(l_orderkey % 17 = 0, 'bad', cast(unix_millis(cast(l_shipdate as timestamp)) div 86400000 * 86400000 as string)) as timestamp_ms",
        "if(l_partkey % 5 = 0, null, l_quantity) as open", "l_quantity as close", "if(l_linenumber % 4 = 0, null, ' EXT_A ') as source",
        "concat_ws('-', lpad(l_orderkey, 12, '0'), l_linenumber, lpad(l_partkey, 12, '0'), lpad(l_suppkey, 8, '0'), lpad(cast(l_quantity as bigint), 6, '0')) as seq",
    )
    return A.lenient_scan(raw, interval_ms=DAY, symbol="fallback", source="native").select("symbol", "timestamp_ms", "open", "high", "close", "source")


@query("SELECT symbol, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, count(*) AS rows FROM ticks GROUP BY symbol")
def series_extent(spark, sf):
    return A.series_extent(X.ticks(spark, sf), ["symbol"], "ts_ms")


MID = 915_148_800_000  # 1999-01-01
VIEWS["upserted"] = f"""SELECT venue, symbol, timestamp_ms, close FROM (SELECT *, row_number() OVER (PARTITION BY venue, symbol, timestamp_ms ORDER BY version DESC, seq DESC) AS rn FROM (
  SELECT venue, symbol, timestamp_ms, close, 0 AS seq, 0 AS version FROM vbars WHERE timestamp_ms < {MID + DAY * 60}
  UNION ALL SELECT venue, symbol, timestamp_ms, close + 1, 1, 1 FROM vbars WHERE timestamp_ms >= {MID} UNION ALL SELECT venue, symbol, timestamp_ms, close + 2, 2, 1 FROM vbars WHERE timestamp_ms >= {MID} AND (timestamp_ms // {DAY}) % 3 = 0)) WHERE rn = 1"""


@query("SELECT * FROM upserted")
def merge_upsert(spark, sf):
    bars = X.vbars(spark, sf).select("venue", "symbol", "timestamp_ms", "close")
    target = bars.where(F.col("timestamp_ms") < MID + DAY * 60).withColumn("seq", F.lit(0))
    late = F.expr(f"(timestamp_ms div {DAY}) % 3 = 0")
    incoming = bars.withColumns({"close": F.col("close") + 1, "seq": F.lit(1)}).unionByName(bars.where(late).withColumns({"close": F.col("close") + 2, "seq": F.lit(2)}))
    return A.merge_upsert(target, incoming, ["venue", "symbol", "timestamp_ms"], "timestamp_ms", MID, V1, "seq").drop("seq")


@query("SELECT runner, seq, ts_ms, ok FROM (SELECT *, row_number() OVER (PARTITION BY runner ORDER BY ts_ms DESC, seq DESC) AS rn FROM cycles) WHERE rn = 1")
def latest_per_key(spark, sf):
    return A.latest(X.cycles(spark, sf).select("runner", "seq", "ts_ms", "ok"), ["runner"], [F.col("ts_ms"), F.col("seq")])


@query("SELECT venue, symbol, timestamp_ms, close FROM vbars WHERE symbol = 'S1'")
def symbol_scan(spark, sf):
    folder = stage_folder(spark)
    A.write_series(X.vbars(spark, sf), folder)
    return A.symbol_scan(spark, folder, ["S1"]).select("venue", "symbol", "timestamp_ms", "close")


@query("SELECT symbol, timestamp_ms, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp_ms ORDER BY CASE venue WHEN 'native' THEN 0 WHEN 'ext_a' THEN 1 ELSE 2 END DESC) AS rn FROM vbars) WHERE rn = 1")
def close_series(spark, sf):
    """The venues' files one after another."""
    seq = F.expr("case venue when 'native' then 0 when 'ext_a' then 1 else 2 end")
    return A.close_series(X.vbars(spark, sf).withColumn("seq", seq), seq="seq")


@query("SELECT fold, scenario, symbol, timestamp_ms, probability, row_key FROM preds WHERE scope = 'global' AND scenario = 'weighted'")
def prediction_scan(spark, sf):
    """One file for the odd folds, one for the even ones."""
    paths = [stage_folder(spark), stage_folder(spark)]
    for k, path in enumerate(paths):
        X.preds(spark, sf).where(F.col("fold") % 2 == k).write.parquet(path)
    return A.prediction_scan(spark, paths, scenario="weighted").select("fold", "scenario", "symbol", "timestamp_ms", "probability", "row_key")


@query("SELECT symbol, venue, timestamp_ms, close FROM vbars WHERE (symbol IN ('S0', 'S2') AND venue = 'ext_a') OR (symbol IN ('S1', 'S3') AND venue = 'ext_b')")
def selected_external(spark, sf):
    bars = X.vbars(spark, sf).select("symbol", "venue", "timestamp_ms", "close")
    even = F.expr("cast(substring(symbol, 2) as int) % 2 = 0")
    selection = bars.select("symbol").distinct().withColumn("venue", F.when(even, "ext_a").otherwise("ext_b"))
    return A.selected_external(bars, selection)


VIEWS["candles"] = """SELECT 'S' || (l_suppkey % 4) AS symbol, CASE WHEN l_orderkey % 13 = 0 THEN [epoch_ms(l_shipdate)::DOUBLE, l_quantity]
  ELSE [epoch_ms(l_shipdate)::DOUBLE + (l_partkey % 100), l_quantity, l_tax, l_discount, l_extendedprice, l_linenumber::DOUBLE] || CASE WHEN l_partkey % 2 = 0 THEN [l_tax + 1, l_tax + 2] ELSE [] END END AS c FROM lineitem"""


def candles(spark, sf):
    return A.read_table(spark, sf, "lineitem").selectExpr(
        "concat('S', l_suppkey % 4) as symbol",
        """if(l_orderkey % 13 = 0, array(cast(unix_millis(cast(l_shipdate as timestamp)) as double), l_quantity),
        concat(array(cast(unix_millis(cast(l_shipdate as timestamp)) as double) + (l_partkey % 100), l_quantity, l_tax, l_discount, l_extendedprice, cast(l_linenumber as double)),
        if(l_partkey % 2 = 0, array(l_tax + 1, l_tax + 2), cast(array() as array<double>)))) as candle""",
    )


@query(f"""SELECT symbol, (floor(c[1] / {DAY}) * {DAY})::BIGINT AS timestamp_ms, c[4] AS open, c[2] AS high, c[3] AS low, c[5] AS close, c[6] AS volume,
  coalesce(c[7], 0) AS inside_bid, coalesce(c[8], 0) AS inside_ask FROM candles WHERE len(c) >= 6""")
def normalize_native(spark, sf):
    return B.normalize_native(candles(spark, sf), interval_ms=DAY)


@query(f"""SELECT symbol, (floor(c[1] / {DAY}) * {DAY})::BIGINT + {DAY} AS timestamp_ms, c[2] AS open, c[3] AS high, c[4] AS low, c[5] AS close, c[6] AS volume,
  0::DOUBLE AS inside_bid, 0::DOUBLE AS inside_ask FROM candles WHERE len(c) >= 6""")
def normalize_open_labelled(spark, sf):
    return B.normalize_open_labelled(candles(spark, sf), interval_ms=DAY)


@query(f"""SELECT symbol, (ceil(timestamp_ms / {4 * HOUR}) * {4 * HOUR})::BIGINT AS timestamp_ms, first(open ORDER BY timestamp_ms) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY timestamp_ms) AS close, sum(volume) AS volume, count(*) AS bars FROM tbars GROUP BY symbol, 2""")
def bar_rollup(spark, sf):
    return B.roll_up(tick_bars(spark, sf), interval_ms=4 * HOUR)


@query(f"SELECT e.symbol, count(*) AS missing FROM (SELECT symbol, unnest(range({T0}, {T1}, {HOUR})) AS timestamp_ms FROM (SELECT DISTINCT symbol FROM tbars)) e ANTI JOIN tbars b USING (symbol, timestamp_ms) GROUP BY 1")
def time_grid(spark, sf):
    bars = tick_bars(spark, sf)
    per = bars.groupBy("symbol").agg(F.count_distinct("timestamp_ms").alias("have"))
    expected = B.time_grid(spark, start_ms=T0, end_ms=T1, interval_ms=HOUR).agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return per.withColumn("_one", F.lit(1)).join(F.broadcast(expected), "_one").select("symbol", (F.col("n") - F.col("have")).alias("missing"))


@query("SELECT * FROM tfull")
def gap_repair(spark, sf):
    return full_tick_bars(spark, sf)


@query("SELECT symbol, max(timestamp_ms) AS timestamp_ms, arg_max(close, timestamp_ms) AS close FROM tbars GROUP BY 1")
def latest_close(spark, sf):
    return B.latest_close(tick_bars(spark, sf))


@query(f"""SELECT venue, symbol, coalesce(sum(greatest(0, (nxt - timestamp_ms) // {DAY} - 1)), 0)::BIGINT AS gap_count
  FROM (SELECT venue, symbol, timestamp_ms, lead(timestamp_ms) OVER (PARTITION BY venue, symbol ORDER BY timestamp_ms) AS nxt FROM vbars) GROUP BY 1, 2""")
def gap_count(spark, sf):
    return Q.gap_count(X.vbars(spark, sf), interval_ms=DAY, keys=("venue", "symbol"))


def dup_bars(spark, sf):
    return A.read_table(spark, sf, "lineitem").selectExpr("concat('S', l_suppkey % 4) as symbol", "unix_millis(cast(l_shipdate as timestamp)) + if(l_partkey % 10 = 0, 5, 0) as timestamp_ms")


@query(f"SELECT symbol, count(*) - count(DISTINCT timestamp_ms) AS duplicate_count, count(*) FILTER (timestamp_ms % {DAY} <> 0) AS misaligned_count FROM dupbars GROUP BY 1")
def dup_misaligned(spark, sf):
    return Q.dup_misaligned(dup_bars(spark, sf), interval_ms=DAY)


VIEWS |= {
    "cov_expected": "SELECT dataset, symbol, symbol <> 'S8' AS has_pair, symbol <> 'S9' AS has_file FROM (SELECT DISTINCT venue AS dataset FROM vbars), (SELECT DISTINCT symbol FROM vbars UNION SELECT unnest(['S7', 'S8', 'S9']))",
    "cov_facts": f"""SELECT venue AS dataset, symbol, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts, count(*) AS row_count,
      coalesce(sum(greatest(0, (nxt - timestamp_ms) // {DAY} - 1)), 0)::BIGINT AS gap_count, count(*) FILTER (source IN ('native', 'live')) AS native_rows
      FROM (SELECT *, lead(timestamp_ms) OVER (PARTITION BY venue, symbol ORDER BY timestamp_ms) AS nxt FROM vbars) GROUP BY 1, 2""",
    "cov_rows": f"""SELECT dataset, symbol, CASE WHEN NOT has_pair THEN 'no_pair' WHEN NOT has_file THEN 'missing_file' WHEN first_ts IS NULL THEN 'empty' ELSE 'ok' END AS status, first_ts, last_ts, coalesce(row_count, 0) AS row_count, coalesce(gap_count, 0) AS gap_count,
      round(CASE WHEN first_ts IS NULL THEN 0 ELSE least(1, row_count / ((last_ts - first_ts) // {DAY} + 1)) END, 9) AS coverage_pct,
      round(coalesce(native_rows, 0) / greatest(1, coalesce(row_count, 0)), 9) AS native_share,
      round((coalesce(row_count, 0) - coalesce(native_rows, 0)) / greatest(1, coalesce(row_count, 0)), 9) AS synth_share
      FROM cov_expected LEFT JOIN cov_facts USING (dataset, symbol)""",
}


@query("""SELECT * FROM cov_rows UNION ALL SELECT dataset, '*', CASE WHEN count(*) FILTER (status <> 'ok') = 0 THEN 'ok' ELSE 'partial' END, min(first_ts), max(last_ts),
  sum(row_count)::BIGINT, sum(gap_count)::BIGINT, round(avg(coverage_pct), 6), round(avg(native_share), 6), round(avg(synth_share), 6) FROM cov_rows GROUP BY dataset""")
def coverage_report(spark, sf):
    bars = X.vbars(spark, sf).withColumnRenamed("venue", "dataset")
    pairs = bars.select("dataset", "symbol").distinct()
    others = bars.select("dataset").distinct().withColumn("symbol", F.explode(F.array(*map(F.lit, ("S7", "S8", "S9")))))
    expected = pairs.unionByName(others).withColumns({"has_pair": F.col("symbol") != "S8", "has_file": F.col("symbol") != "S9"})
    return Q.coverage_report(bars, expected, interval_ms=DAY)


@query(f"SELECT symbol, count(*) AS rows, round(greatest(0, least(1, count(*) / {(T1 - T0) // HOUR})), 9) AS coverage_pct FROM tbars GROUP BY 1")
def coverage_range(spark, sf):
    return Q.coverage_of_range(tick_bars(spark, sf), start_ms=T0, end_ms=T1, interval_ms=HOUR)


@query(f"""WITH RECURSIVE have AS (SELECT symbol, timestamp_ms // {DAY} AS day, count(DISTINCT timestamp_ms) AS n FROM tfull WHERE timestamp_ms >= {T0} AND timestamp_ms < {T1} AND source = 'native' GROUP BY 1, 2),
  missing AS (SELECT symbol, day FROM (SELECT symbol, unnest(range({T0 // DAY}, {T1 // DAY})) AS day FROM (SELECT DISTINCT symbol FROM tbars)) d ANTI JOIN (SELECT * FROM have WHERE n >= 24) h USING (symbol, day)),
  isl AS (SELECT *, day - row_number() OVER (PARTITION BY symbol ORDER BY day) AS island FROM missing),
  ch AS (SELECT *, (row_number() OVER (PARTITION BY symbol, island ORDER BY day) - 1) // 5 AS chunk FROM isl)
  SELECT symbol, min(day) AS from_day, max(day) AS to_day, count(*) AS days FROM ch GROUP BY symbol, island, chunk""")
def missing_windows(spark, sf):
    return Q.missing_windows(tick_bars(spark, sf), start_ms=T0, end_ms=T1, interval_ms=HOUR, max_days=5)


@query(f"""WITH b AS (SELECT venue, symbol, count(*) AS rows_before FROM vbars WHERE timestamp_ms < {MID} GROUP BY 1, 2), g AS (SELECT venue, symbol, coalesce(sum(greatest(0, (nxt - timestamp_ms) // {DAY} - 1)), 0)::BIGINT AS gap_count
  FROM (SELECT venue, symbol, timestamp_ms, lead(timestamp_ms) OVER (PARTITION BY venue, symbol ORDER BY timestamp_ms) AS nxt FROM upserted) GROUP BY 1, 2)
  SELECT venue, symbol, rows_after, first_ts, last_ts, coalesce(rows_before, 0) AS rows_before, gap_count, rows_after - coalesce(rows_before, 0) AS rows_added
  FROM (SELECT venue, symbol, count(*) AS rows_after, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts FROM upserted GROUP BY 1, 2) LEFT JOIN b USING (venue, symbol) JOIN g USING (venue, symbol)""")
def ingest_summary(spark, sf):
    return Q.ingest_summary(X.vbars(spark, sf).where(F.col("timestamp_ms") < MID), merge_upsert(spark, sf), interval_ms=DAY)


@query("""SELECT dataset, symbol, unnest([x FOR x IN [CASE WHEN gap_count % 2 = 1 THEN 'duplicates' END, CASE WHEN row_count % 3 = 0 THEN 'misaligned' END,
  CASE WHEN dataset = 'combined' AND gap_count > 10 THEN 'gaps' END, CASE WHEN dataset = 'combined' AND coverage_pct < 0.99 THEN 'coverage' END] IF x IS NOT NULL]) AS violation
  FROM (SELECT CASE WHEN dataset = 'native' THEN 'combined' ELSE dataset END AS dataset, symbol, gap_count, row_count, coverage_pct FROM cov_rows)""")
def quality_gate(spark, sf):
    report = coverage_report(spark, sf).where("symbol <> '*'").selectExpr(
        "if(dataset = 'native', 'combined', dataset) as dataset", "symbol", "gap_count", "gap_count % 2 as duplicate_count", "if(row_count % 3 = 0, 1, 0) as misaligned_count", "coverage_pct"
    )
    return Q.quality_gate(report, max_gaps=10, min_coverage=0.99)


@query("SELECT count(*) FILTER (n >= 601) AS warm, count(*) AS symbols, count(*) FILTER (n >= 601) / count(*) + 1e-12 >= 0.5 AS ok FROM (SELECT symbol, count(DISTINCT timestamp_ms) AS n FROM tbars GROUP BY 1)")
def warmup_coverage(spark, sf):
    bars = tick_bars(spark, sf)
    return Q.warmup_coverage(bars, X.ticks(spark, sf).select("symbol").distinct(), slow=600, atr=14, min_share=0.5)


@query("SELECT venue, source, count(*) AS rows FROM vbars GROUP BY 1, 2")
def source_mix(spark, sf):
    return Q.source_mix(X.vbars(spark, sf), ("venue",))


@query()
def content_hash(spark, sf):
    return Q.content_hash(X.vbars(spark, sf).where("venue = 'native'"), ("symbol", "timestamp_ms", "open", "high", "low", "close", "volume", "source"))


VIEWS["instruments"] = """SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'B' || (c_custkey % 40) END AS base, CASE WHEN c_nationkey % 3 = 0 THEN 'CAD' ELSE 'USD' END AS quote,
  'P' || c_custkey AS symbol, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey END AS instrument_id FROM customer"""


@query("""SELECT w.base, symbol, instrument_id, CASE WHEN instrument_id IS NULL THEN 'not_listed' END AS reason FROM (SELECT DISTINCT 'B' || (s_suppkey % 60) AS base FROM supplier) w
  LEFT JOIN (SELECT * FROM (SELECT upper(trim(base)) AS base, symbol, instrument_id, row_number() OVER (PARTITION BY upper(trim(base)) ORDER BY seq DESC) AS rn FROM instruments
  WHERE quote = 'CAD' AND instrument_id > 0 AND trim(base) <> '') WHERE rn = 1) USING (base)""")
def universe_resolve(spark, sf):
    instruments = A.read_table(spark, sf, "customer").selectExpr(
        "c_custkey as seq", "if(c_custkey % 11 = 0, ' ', concat('B', c_custkey % 40)) as base", "if(c_nationkey % 3 = 0, 'CAD', 'USD') as quote",
        "concat('P', c_custkey) as symbol", "if(c_custkey % 7 = 0, 0, c_custkey) as instrument_id",
    )
    wanted = A.read_table(spark, sf, "supplier").selectExpr("concat('B', s_suppkey % 60) as base").distinct()
    return Q.resolve_universe(instruments, wanted, quote="CAD", seq="seq")


VIEWS["pairs"] = """SELECT CASE c_custkey % 30 WHEN 0 THEN 'XBT' WHEN 1 THEN 'XDG' ELSE 'B' || (c_custkey % 30) END AS base, ['CAD', 'USD', 'USDT', 'USDC', 'EUR'][c_custkey % 5 + 1] AS quote, 'Q' || c_custkey AS pair,
  CASE WHEN c_custkey % 6 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status, c_custkey % 9 <> 0 AS spot FROM customer"""


@query("""SELECT w.base, pair, quote FROM (SELECT DISTINCT CASE c_custkey % 30 WHEN 0 THEN 'BTC' WHEN 1 THEN 'DOGE' ELSE 'B' || (c_custkey % 30) END AS base FROM customer) w LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY list_position(['CAD', 'USD', 'USDT', 'USDC'], quote), pair DESC) AS rn FROM
  (SELECT CASE base WHEN 'XBT' THEN 'BTC' WHEN 'XDG' THEN 'DOGE' ELSE base END AS base, quote, pair FROM pairs WHERE status = 'TRADING' AND spot AND quote <> 'EUR')) WHERE rn = 1) USING (base)""")
def pair_resolve(spark, sf):
    rows = A.read_table(spark, sf, "customer")
    pairs = rows.selectExpr(
        "case c_custkey % 30 when 0 then 'XBT' when 1 then 'XDG' else concat('B', c_custkey % 30) end as base", "element_at(array('CAD', 'USD', 'USDT', 'USDC', 'EUR'), cast(c_custkey % 5 + 1 as int)) as quote",
        "concat('Q', c_custkey) as pair", "if(c_custkey % 6 = 0, 'BREAK', 'TRADING') as status", "c_custkey % 9 <> 0 as spot",
    )
    wanted = rows.selectExpr("case c_custkey % 30 when 0 then 'BTC' when 1 then 'DOGE' else concat('B', c_custkey % 30) end as base").distinct()
    return Q.resolve_pairs(pairs, wanted)


@query("""SELECT pair, coalesce(nullif(regexp_extract(upper(pair), '(USDT|USDC|CAD|USD|EUR|GBP|AUD)$', 1), ''), right(upper(pair), 3)) AS quote,
  CASE WHEN coalesce(nullif(regexp_extract(upper(pair), '(USDT|USDC|CAD|USD|EUR|GBP|AUD)$', 1), ''), right(upper(pair), 3)) = 'CAD' THEN 'CAD' ELSE 'USD' END AS quote_group
  FROM (SELECT 'b' || c_custkey || ['usdt', 'CAD', 'usd', 'JPY', 'GBP'][c_custkey % 5 + 1] AS pair FROM customer)""")
def quote_suffix(spark, sf):
    pairs = A.read_table(spark, sf, "customer").selectExpr("concat('b', c_custkey, element_at(array('usdt', 'CAD', 'usd', 'JPY', 'GBP'), cast(c_custkey % 5 + 1 as int))) as pair")
    q = Q.quote_currency(F.col("pair"))
    return pairs.select("pair", q.alias("quote"), Q.quote_group(q).alias("quote_group"))


@query()
def tick_csv_scan(spark, sf):
    """Ticks written as CSV lines in the shared folder, some malformed, scanned again."""
    folder = stage_folder(spark)
    text = F.expr("if(seq % 50 = 0, concat(seq, ',x'), concat_ws(',', format_string('%.3f', ts_ms / 1000D), cast(price as string), cast(volume as string)))")
    X.ticks(spark, sf).select(text.alias("value")).write.text(folder)
    return A.tick_csv_scan(spark, folder, start_ms=T0, end_ms=T1)
