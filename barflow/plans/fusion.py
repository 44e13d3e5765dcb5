"""Cross-source normalisation, calibration and weights."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_key
from ..operators import calibrate as C
from ..operators import normalize as N
from ..sources import fixtures as X
from ..sources.staging import staged
from . import VIEWS, query

DAY = X.DAY
MIN_ROWS, MAX_APE = 12, 0.05
MONTH = "strftime(epoch_ms(timestamp_ms), '%Y-%m')"


def _robust(rows: str, keys: str, value: str, alias: str) -> str:
    return f"""SELECT {keys}, median({value}) AS {alias}, max(n) AS {alias}_rows FROM (SELECT {keys}, {value}, count({value}) OVER (PARTITION BY {keys}) AS n,
      row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS r FROM {rows} WHERE {value} IS NOT NULL)
      WHERE n < 8 OR (r >= floor(n * 0.05::DOUBLE) AND r < greatest(floor(n * 0.05::DOUBLE) + 1, floor(n * 0.95::DOUBLE))) GROUP BY {keys}"""


VIEWS |= {
    "nat": "SELECT * FROM vbars WHERE venue = 'native' AND symbol <> 'S3'",
    "ext": "SELECT *, CASE WHEN venue = 'ext_b' AND symbol IN ('S0', 'S1') THEN 'CAD' ELSE 'USD' END AS quote_currency FROM vbars WHERE venue <> 'native'",
    "obs": f"""SELECT e.venue, e.symbol, e.timestamp_ms, strftime(epoch_ms(e.timestamp_ms), '%Y-%m') AS month, n.close AS native_close, e.close AS ext_close, n.close / e.close AS ratio,
      CASE WHEN e.quote_currency = 'CAD' THEN n.close / e.close / 1::DOUBLE WHEN rate > 0 THEN n.close / e.close / rate END AS basis FROM nat n JOIN ext e ON n.symbol = e.symbol AND n.timestamp_ms = e.timestamp_ms
      LEFT JOIN fx ON fx.timestamp_ms = e.timestamp_ms WHERE e.source NOT LIKE '%_fill' AND n.close > 0 AND e.close > 0""",
    "obs2": "SELECT venue, symbol, month, ratio, basis FROM obs UNION ALL SELECT venue, symbol, '*', ratio, basis FROM obs",
    "ctx": f"""SELECT venue, symbol, month, ratio_median, ratio_median_rows, basis_median, basis_median_rows FROM ({_robust('obs2', 'venue, symbol, month', 'ratio', 'ratio_median')})
      LEFT JOIN ({_robust('obs2', 'venue, symbol, month', 'basis', 'basis_median')}) USING (venue, symbol, month)""",
    "shared2": "SELECT CASE WHEN quote_currency = 'CAD' THEN 'CAD' ELSE 'USD' END AS quote_group, month, ratio, basis FROM obs2 JOIN (SELECT symbol, venue, max(quote_currency) AS quote_currency FROM ext JOIN chosen USING (symbol, venue) GROUP BY 1, 2) USING (symbol, venue)",
    "shared": f"""SELECT quote_group, month, ratio_median, ratio_median_rows, basis_median, basis_median_rows FROM ({_robust('shared2', 'quote_group, month', 'ratio', 'ratio_median')})
      LEFT JOIN ({_robust('shared2', 'quote_group, month', 'basis', 'basis_median')}) USING (quote_group, month)""",
    "rated": """SELECT v.*, CASE WHEN quote_currency = 'CAD' THEN 1 WHEN f.timestamp_ms IS NULL OR v.timestamp_ms - b.timestamp_ms <= f.timestamp_ms - v.timestamp_ms THEN b.rate ELSE f.rate END AS rate
      FROM ext v ASOF LEFT JOIN fx b ON v.timestamp_ms >= b.timestamp_ms ASOF LEFT JOIN fx f ON v.timestamp_ms <= f.timestamp_ms""",
    "factored": """SELECT r.*, strftime(epoch_ms(r.timestamp_ms), '%Y-%m') AS month, coalesce(CASE WHEN rate * coalesce(m.basis_median, g.basis_median) > 0 THEN rate * coalesce(m.basis_median, g.basis_median) END,
      CASE WHEN m.ratio_median > 0 THEN m.ratio_median END, CASE WHEN g.ratio_median > 0 THEN g.ratio_median END) AS factor FROM rated r
      LEFT JOIN ctx m ON m.venue = r.venue AND m.symbol = r.symbol AND m.month = strftime(epoch_ms(r.timestamp_ms), '%Y-%m')
      LEFT JOIN ctx g ON g.venue = r.venue AND g.symbol = r.symbol AND g.month = '*'""",
    "sharedf": """SELECT r.venue, r.symbol, r.timestamp_ms, coalesce(factor, CASE WHEN rate * coalesce(m.basis_median, g.basis_median) > 0 THEN rate * coalesce(m.basis_median, g.basis_median) END,
      CASE WHEN m.ratio_median > 0 THEN m.ratio_median END, CASE WHEN g.ratio_median > 0 THEN g.ratio_median END) AS factor, r.source, open, high, low, close, volume, rate FROM factored r
      LEFT JOIN shared m ON m.quote_group = CASE WHEN r.quote_currency = 'CAD' THEN 'CAD' ELSE 'USD' END AND m.month = r.month
      LEFT JOIN shared g ON g.quote_group = CASE WHEN r.quote_currency = 'CAD' THEN 'CAD' ELSE 'USD' END AND g.month = '*'""",
    "points": "SELECT f.venue, f.symbol, f.month, f.timestamp_ms, n.close AS native_close, f.close AS ext_close, f.rate, f.factor FROM factored f JOIN nat n ON n.symbol = f.symbol AND n.timestamp_ms = f.timestamp_ms WHERE f.source NOT LIKE '%_fill' AND f.factor > 0 AND n.close > 0 AND f.close > 0",
    "rets": """SELECT *, native_close / lag(native_close) OVER w - 1 AS rn, ext_close * factor / lag(ext_close * factor) OVER w - 1 AS rs, abs(ext_close * factor - native_close) / native_close AS ape,
      CASE WHEN rate > 0 THEN native_close / (ext_close * rate) END AS b FROM points WINDOW w AS (PARTITION BY venue, symbol, month ORDER BY timestamp_ms)""",
    "metrics": """SELECT a.*, coalesce(basis_mad0, 1) AS basis_mad FROM (SELECT venue, symbol, month, count(*) AS overlap_rows, median(ape) AS median_ape_close, coalesce(median(abs(rs - rn)), 1) AS median_abs_ret_err,
      CASE WHEN count(rn) > 1 AND stddev_pop(rn) > 0 AND stddev_pop(rs) > 0 THEN corr(rn, rs) ELSE 0 END AS ret_corr, coalesce(avg(CASE WHEN rn IS NOT NULL AND rs IS NOT NULL THEN (sign(rn) = sign(rs))::INT END), 0) AS direction_match,
      coalesce(median(b), 1) AS basis_median FROM rets GROUP BY ALL) a
      LEFT JOIN (SELECT venue, symbol, month, median(abs(b - m)) AS basis_mad0 FROM (SELECT *, median(b) OVER (PARTITION BY venue, symbol, month) AS m FROM rets) GROUP BY ALL) USING (venue, symbol, month)""",
    "scored": f"""SELECT *, 0.35::DOUBLE * greatest(0, least(1, 1 - median_ape_close / {MAX_APE}::DOUBLE)) + 0.25::DOUBLE * greatest(0, least(1, 1 - median_abs_ret_err / {MAX_APE}::DOUBLE)) + 0.20::DOUBLE * greatest(0, least(1, ret_corr))
      + 0.10::DOUBLE * greatest(0, least(1, direction_match)) + 0.10::DOUBLE * greatest(0, least(1, 1 - basis_mad / {MAX_APE}::DOUBLE)) AS score,
      overlap_rows >= {MIN_ROWS} AND median_ape_close <= {MAX_APE} AND ret_corr >= 0.30 AS quality_pass FROM metrics""",
    "cand": "SELECT symbol, venue, count(*) AS rows, max(CASE venue WHEN 'ext_a' THEN 0 ELSE 1 END) AS priority FROM ext GROUP BY 1, 2",
    "whole": """SELECT venue, symbol, avg(score) AS score, bool_or(quality_pass) AS quality_pass, sum(overlap_rows)::BIGINT AS overlap_rows FROM scored GROUP BY 1, 2""",
    "chosen": """SELECT symbol, venue FROM (SELECT symbol, venue, row_number() OVER (PARTITION BY symbol ORDER BY quality_pass DESC, round(score, 6) DESC, overlap_rows DESC, priority) AS rn
      FROM (SELECT symbol, venue, rows, priority, coalesce(quality_pass, false) AS quality_pass, coalesce(score, 0) AS score, coalesce(overlap_rows, 0) AS overlap_rows FROM cand LEFT JOIN whole USING (symbol, venue))) WHERE rn = 1""",
    "fused": f"""SELECT symbol, timestamp_ms, first(open ORDER BY rk) AS open, first(high ORDER BY rk) AS high, first(low ORDER BY rk) AS low, first(close ORDER BY rk) AS close, first(volume ORDER BY rk) AS volume, first(source ORDER BY rk) AS source FROM (
      SELECT symbol, timestamp_ms, open, high, low, close, volume, source, 0 AS rk FROM nat UNION ALL
      SELECT symbol, timestamp_ms, open * factor, high * factor, low * factor, close * factor, volume, CASE WHEN source LIKE '%_fill' THEN 'synthetic_fill' ELSE 'synthetic' END,
      CASE WHEN (symbol, venue) IN (SELECT (symbol, venue) FROM chosen) THEN 1 ELSE 2 END FROM sharedf WHERE factor > 0) WHERE timestamp_ms % {DAY} = 0 GROUP BY 1, 2""",
    "cal": "SELECT s.* FROM scored s JOIN chosen USING (symbol, venue)",
    "calrets": "SELECT r.* FROM rets r JOIN chosen USING (symbol, venue)",
    "gridw": """SELECT symbol, month, w AS weight_backtest, n AS trades FROM (SELECT *, row_number() OVER (PARTITION BY symbol, month ORDER BY round(coalesce(m - 0.5::DOUBLE * CASE WHEN n = 1 THEN abs(m) ELSE sd END, -1e300), 12) DESC, w) AS rn FROM (
      SELECT symbol, month, w, median(pnl) AS m, stddev_pop(pnl) AS sd, count(pnl) AS n FROM (SELECT symbol, month, w, CASE WHEN abs(w * rs) > 2 * 0.002::DOUBLE THEN sign(w * rs) * rn - 2 * 0.002::DOUBLE END AS pnl
      FROM (SELECT symbol, month, rn, rs, round(0.2::DOUBLE + 0.05::DOUBLE * i, 4) AS w FROM calrets, range(13) t(i) WHERE rn IS NOT NULL AND rs IS NOT NULL)) GROUP BY 1, 2, 3)) WHERE rn = 1""",
    "fusedw": """SELECT c.*, coalesce(weight_backtest, 0.5) AS weight_backtest, least(0.8::DOUBLE, greatest(0.2::DOUBLE, 0.2::DOUBLE + (0.8::DOUBLE - 0.2::DOUBLE) * score)) AS weight_quality FROM cal c LEFT JOIN gridw USING (symbol, month)""",
    "raww": "SELECT *, 0.6::DOUBLE * weight_quality + 0.4::DOUBLE * weight_backtest AS weight_raw FROM fusedw",
    "shrunk": f"""SELECT *, CASE WHEN quality_pass AND overlap_rows >= {MIN_ROWS} THEN least(0.8::DOUBLE, greatest(0.2::DOUBLE, overlap_rows / (overlap_rows + 5000) * weight_raw + (1 - overlap_rows / (overlap_rows + 5000)) * weight_global)) ELSE 0.25 END AS weight_final
      FROM (SELECT *, coalesce((SELECT median(weight_raw) FROM raww WHERE quality_pass), 0.5) AS weight_global FROM raww)""",
    "grid_months": "SELECT symbol, month FROM (SELECT DISTINCT symbol FROM vbars), (SELECT DISTINCT strftime(epoch_ms(timestamp_ms), '%Y-%m') AS month FROM vbars)",
    "elig0": f"""SELECT symbol, month, coalesce(overlap_rows, 0) AS overlap_rows, coalesce(overlap_rows >= {MIN_ROWS} AND median_ape_close <= {MAX_APE} AND ret_corr >= 0.30, false) AS direct, coalesce(weight_final, 0.25) AS weight_final
      FROM grid_months LEFT JOIN shrunk USING (symbol, month)""",
    "elig1": """SELECT *, last(CASE WHEN direct THEN month END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef,
      first(CASE WHEN direct THEN month END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft FROM elig0""",
    "elig": """SELECT symbol, month, overlap_rows, weight_final, CASE WHEN direct THEN 'direct' WHEN overlap_rows = 0 AND bef IS NOT NULL THEN 'carry_forward' WHEN overlap_rows = 0 AND aft IS NOT NULL THEN 'carry_backward' ELSE 'blocked' END AS eligibility_mode,
      CASE WHEN direct THEN month WHEN overlap_rows = 0 THEN coalesce(bef, aft) END AS anchor_month FROM elig1""",
}


KEYS = ("venue", "symbol", "month")


class Fusion:
    """The parts of a fusion and calibration run; what several later parts use is staged once."""

    def __init__(self, spark, sf: str) -> None:
        self.spark, self.sf = spark, sf

    @cached_property
    def bars(self) -> DataFrame:
        return staged(X.vbars(self.spark, self.sf))

    @cached_property
    def native(self) -> DataFrame:
        """One symbol has no native history: its bars come by the shared context."""
        return self.bars.where("venue = 'native' and symbol <> 'S3'")

    @cached_property
    def external(self) -> DataFrame:
        quote = F.expr("case when venue = 'ext_b' and symbol in ('S0', 'S1') then 'CAD' else 'USD' end")
        return self.bars.where("venue <> 'native'").withColumn("quote_currency", quote)

    @cached_property
    def fx(self) -> DataFrame:
        return staged(X.fx(self.spark, self.sf))

    @cached_property
    def observations(self) -> DataFrame:
        return staged(N.overlap_observations(self.native, self.external, self.fx))

    @cached_property
    def context(self) -> DataFrame:
        return N.conversion_context(self.observations, ["venue", "symbol"])

    @cached_property
    def factored(self) -> DataFrame:
        return staged(N.factors(self.external, self.context, self.fx, ["venue", "symbol"]))

    @cached_property
    def points(self) -> DataFrame:
        native = self.native.where("close > 0").select("symbol", "timestamp_ms", F.col("close").alias("native_close"))
        ext = self.factored.where("source not like '%_fill' and factor > 0 and close > 0")
        return ext.select("venue", "symbol", "month", "timestamp_ms", F.col("close").alias("ext_close"), "rate", "factor").join(native, ["symbol", "timestamp_ms"])

    @cached_property
    def metrics(self) -> DataFrame:
        return C.overlap_metrics(self.points, keys=KEYS)

    @cached_property
    def scored(self) -> DataFrame:
        return staged(C.quality_score(self.metrics, min_rows=MIN_ROWS, max_ape=MAX_APE))

    @cached_property
    def chosen(self) -> DataFrame:
        """One venue per symbol."""
        counts = self.external.groupBy("symbol", "venue").agg(F.count(F.lit(1)).alias("rows"))
        counts = counts.withColumn("priority", F.when(F.col("venue") == "ext_a", 0).otherwise(1))
        whole = self.scored.groupBy("symbol", "venue").agg(
            F.round(F.avg("score"), 6).alias("score"), F.max("quality_pass").alias("quality_pass"), F.sum("overlap_rows").alias("overlap_rows")
        )
        rated = counts.join(whole, ["symbol", "venue"], "left").fillna({"score": 0.0, "quality_pass": False, "overlap_rows": 0})
        return staged(N.select_source(rated).select("symbol", "venue"))

    @cached_property
    def shared(self) -> DataFrame:
        quotes = self.external.select("symbol", "venue", "quote_currency").distinct()
        return N.shared_context(self.observations, self.chosen.join(quotes, ["symbol", "venue"]))

    @cached_property
    def converted(self) -> DataFrame:
        """External bars with the factor of their own context or the shared one."""
        return N.with_shared(self.factored, self.shared, self.fx)

    @cached_property
    def fused(self) -> DataFrame:
        marked = self.converted.join(self.chosen.withColumn("_chosen", F.lit(True)), ["symbol", "venue"], "left")
        return N.combined_bars(self.native, marked.where("_chosen"), marked.where("_chosen is null"), interval_ms=DAY)

    @cached_property
    def grid(self) -> DataFrame:
        w = Window.partitionBy(*KEYS).orderBy("timestamp_ms")
        rows = self.points.join(self.chosen, ["symbol", "venue"]).withColumn("synth", F.col("ext_close") * F.col("factor"))
        return C.grid_weight(rows.withColumns({"rn": F.col("native_close") / F.lag("native_close").over(w) - 1, "rs": F.col("synth") / F.lag("synth").over(w) - 1}))

    @cached_property
    def weights(self) -> DataFrame:
        months = self.scored.join(self.chosen, ["symbol", "venue"])
        return staged(C.weight_fusion(months.join(self.grid, ["symbol", "month"], "left").fillna({"weight_backtest": 0.5})))

    @cached_property
    def shrunk(self) -> DataFrame:
        return C.weight_shrinkage(self.weights, min_rows=MIN_ROWS)

    @cached_property
    def eligible(self) -> DataFrame:
        """Every symbol in every month of the calendar."""
        months = self.bars.select(month_key(F.col("timestamp_ms")).alias("month")).distinct()
        span = months.agg(F.collect_list("month").alias("m")).select("m", F.lit(1).alias("_one"))  # as many as there are months
        calendar = self.bars.select("symbol", F.lit(1).alias("_one")).distinct().join(span, "_one").select("symbol", F.explode("m").alias("month"))
        rows = calendar.join(self.shrunk, ["symbol", "month"], "left").fillna({"overlap_rows": 0, "weight_final": 0.25, "ret_corr": 0.0, "median_ape_close": 1.0})
        return C.eligibility(rows, min_rows=MIN_ROWS, max_ape=MAX_APE, least_rows=MIN_ROWS)  # daily bars: a month never has 250


@query("SELECT * FROM obs")
def overlap_obs(spark, sf):
    return Fusion(spark, sf).observations


@query(_robust("vbars", "venue, symbol", "close", "value"))
def robust_median(spark, sf):
    return N.robust_median(X.vbars(spark, sf), ["venue", "symbol"], "close")


@query("SELECT * FROM ctx")
def conversion_context(spark, sf):
    return Fusion(spark, sf).context


@query("SELECT * FROM shared")
def shared_context(spark, sf):
    return Fusion(spark, sf).shared


@query("SELECT venue, symbol, timestamp_ms, rate FROM rated WHERE quote_currency <> 'CAD'")
def asof_nearest(spark, sf):
    run = Fusion(spark, sf)
    return N.asof_nearest(run.external.where("quote_currency <> 'CAD'").select("venue", "symbol", "timestamp_ms"), run.fx)


@query("SELECT venue, symbol, timestamp_ms, rate, factor FROM factored")
def conversion_factor(spark, sf):
    return Fusion(spark, sf).factored.select("venue", "symbol", "timestamp_ms", "rate", "factor")


@query("SELECT venue, symbol, timestamp_ms, factor FROM sharedf")
def shared_factor(spark, sf):
    return Fusion(spark, sf).converted.select("venue", "symbol", "timestamp_ms", "factor")


@query("SELECT * FROM chosen")
def source_selection(spark, sf):
    return Fusion(spark, sf).chosen


@query("SELECT * FROM fused")
def combined_bars(spark, sf):
    return Fusion(spark, sf).fused


@query(f"""SELECT symbol, coalesce(nr, 0) AS native_rows, coalesce(er, 0) AS external_rows, cr AS combined_rows, gap_count, round(ni / cr, 9) AS native_share, round(1 - ni / cr, 9) AS synth_share,
  CASE WHEN gap_count > 0 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT symbol, count(*) AS cr, count(*) FILTER (source = 'native') AS ni, coalesce(sum(greatest(0, (nxt - timestamp_ms) // {DAY} - 1)), 0)::BIGINT AS gap_count
  FROM (SELECT *, lead(timestamp_ms) OVER (PARTITION BY symbol ORDER BY timestamp_ms) AS nxt FROM fused) GROUP BY 1)
  LEFT JOIN (SELECT symbol, count(DISTINCT timestamp_ms) AS nr FROM nat GROUP BY 1) USING (symbol) LEFT JOIN (SELECT symbol, count(DISTINCT timestamp_ms) AS er FROM ext GROUP BY 1) USING (symbol)""")
def combined_summary(spark, sf):
    run = Fusion(spark, sf)
    return N.combined_summary(staged(run.fused), run.native, run.external, run.bars.select("symbol").distinct(), interval_ms=DAY)


FLOATS = ("median_ape_close", "median_abs_ret_err", "ret_corr", "direction_match", "basis_median", "basis_mad")


def nine(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"SELECT venue, symbol, month, overlap_rows, {', '.join(f'round({c}, 9) AS {c}' for c in FLOATS)} FROM metrics")
def overlap_metrics(spark, sf):
    return nine(Fusion(spark, sf).metrics, *FLOATS)


@query("SELECT venue, symbol, month, round(score, 9) AS score, quality_pass FROM scored")
def quality_score(spark, sf):
    return nine(Fusion(spark, sf).scored.select(*KEYS, "score", "quality_pass"), "score")


@query("""WITH edge AS (SELECT min(epoch_ms(timestamp_ms))::DATE AS a, max(epoch_ms(timestamp_ms))::DATE AS b FROM vbars)
  SELECT strftime(m, '%Y-%m') AS month, greatest(a, m::DATE)::VARCHAR AS from_date, least(b, last_day(m::DATE))::VARCHAR AS to_date FROM edge, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS t(m)""")
def month_ranges(spark, sf):
    edge = X.vbars(spark, sf).agg(F.to_date(F.timestamp_millis(F.min("timestamp_ms"))).cast("string"), F.to_date(F.timestamp_millis(F.max("timestamp_ms"))).cast("string")).first()
    rows = C.month_ranges(spark, edge[0], edge[1])
    return rows.select("month", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"))


@query("SELECT * FROM gridw")
def grid_weight(spark, sf):
    return Fusion(spark, sf).grid


@query("SELECT symbol, month, round(weight_quality, 9) AS weight_quality, weight_backtest, round(weight_raw, 9) AS weight_raw FROM raww")
def weight_fusion(spark, sf):
    return nine(Fusion(spark, sf).weights.select("symbol", "month", "weight_quality", "weight_backtest", "weight_raw"), "weight_quality", "weight_raw")


@query("SELECT symbol, month, round(weight_raw, 9) AS weight_raw, round(weight_global, 9) AS weight_global, round(weight_final, 9) AS weight_final FROM shrunk")
def weight_shrinkage(spark, sf):
    return nine(Fusion(spark, sf).shrunk.select("symbol", "month", "weight_raw", "weight_global", "weight_final"), "weight_raw", "weight_global", "weight_final")


@query("SELECT symbol, month, overlap_rows, eligibility_mode, anchor_month FROM elig")
def eligibility(spark, sf):
    return Fusion(spark, sf).eligible.select("symbol", "month", "overlap_rows", "eligibility_mode", "anchor_month")


@query("SELECT symbol, month, overlap_rows, round(weight_final, 9) AS weight_final, eligibility_mode, anchor_month, eligibility_mode <> 'blocked' AS supervised_eligible FROM elig")
def calibrate_weights(spark, sf):
    return nine(Fusion(spark, sf).eligible.select("symbol", "month", "overlap_rows", "weight_final", "eligibility_mode", "anchor_month", "supervised_eligible"), "weight_final")


@query("SELECT symbol, month, round(weight_final, 9) AS weight_final, eligibility_mode FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY month DESC) AS rn FROM elig) WHERE rn = 1")
def weight_status(spark, sf):
    return nine(C.latest_weight(Fusion(spark, sf).eligible).select("symbol", "month", "weight_final", "eligibility_mode"), "weight_final")


@query(f"""SELECT 'weights' AS basis, round(avg((eligibility_mode <> 'blocked')::INT), 9) AS pass_rate FROM elig
  UNION ALL SELECT 'quality', round(avg(quality_pass::INT), 9) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, month ORDER BY venue DESC) AS rn FROM scored WHERE overlap_rows >= {MIN_ROWS}) WHERE rn = 1""")
def conversion_pass_rate(spark, sf):
    """By the weights, and by the quality rows alone, as if there were no weights; a later venue's row of a period replaces an earlier one."""
    run = Fusion(spark, sf)
    rows, quality = staged(run.eligible), run.scored.withColumns({"period": F.col("month"), "updated": F.col("venue")})
    symbols = run.bars.select("symbol").distinct()
    parts = {"weights": rows, "quality": rows.limit(0)}
    made = [C.conversion_pass_rate(w, quality, symbols, min_rows=MIN_ROWS).select(F.lit(k).alias("basis"), "pass_rate") for k, w in parts.items()]
    return made[0].unionByName(made[1])
