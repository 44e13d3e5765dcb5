"""Quality of converted months, sample weights and their eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, sign
from ..sources.tables import latest


def overlap_metrics(points: DataFrame, *, keys: tuple[str, ...] = ("symbol", "month")) -> DataFrame:
    """Per (symbol, month) over overlap points ``(native_close, factor, ext_close, rate)``: errors, correlation, direction, basis.

    Returns run between consecutive points, also over gaps. Months without points don't appear; callers fill the defaults.
    """
    w = Window.partitionBy(*keys).orderBy("timestamp_ms")
    synth = F.col("ext_close") * F.col("factor")
    rows = points.withColumn("synth", synth)
    ret = lambda c: F.col(c) / F.lag(c).over(w) - 1
    rows = rows.withColumns(
        {
            "ape": F.abs(F.col("synth") - F.col("native_close")) / F.col("native_close"),
            "rn": ret("native_close"),
            "rs": ret("synth"),
            "basis": F.when(F.col("rate") > 0, F.col("native_close") / (F.col("ext_close") * F.col("rate"))),
        }
    )
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("overlap_rows"),
        F.median("ape").alias("median_ape_close"),
        F.median(F.abs(F.col("rs") - F.col("rn"))).alias("median_abs_ret_err"),
        F.nanvl(F.corr("rn", "rs"), F.lit(0.0)).alias("ret_corr"),
        F.avg((sign(F.col("rn")) == sign(F.col("rs"))).cast("double")).alias("direction_match"),
        F.median("basis").alias("basis_median"),
    )
    deviation = rows.select(*keys, "basis").join(agg.select(*keys, "basis_median"), list(keys))
    mad = deviation.groupBy(*keys).agg(F.median(F.abs(F.col("basis") - F.col("basis_median"))).alias("basis_mad"))
    joined = agg.join(mad, list(keys), "left")
    return joined.fillna({"median_abs_ret_err": 1.0, "ret_corr": 0.0, "direction_match": 0.0, "basis_median": 1.0, "basis_mad": 1.0})


def quality_score(metrics: DataFrame, *, min_rows: int, max_ape: float) -> DataFrame:
    """Q = .35 price + .25 return + .20 correlation + .10 direction + .10 basis, each within 0..1, and whether the month passes."""
    #: The weights of the five parts.
    q = (
        0.35 * clamp(1 - F.col("median_ape_close") / max_ape)
        + 0.25 * clamp(1 - F.col("median_abs_ret_err") / max_ape)
        + 0.20 * clamp(F.col("ret_corr"))
        + 0.10 * clamp(F.col("direction_match"))
        + 0.10 * clamp(1 - F.col("basis_mad") / max_ape)
    )
    ok = (F.col("overlap_rows") >= min_rows) & (F.col("median_ape_close") <= max_ape) & (F.col("ret_corr") >= 0.30)
    return metrics.withColumns({"score": q, "quality_pass": ok})


def month_ranges(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Months of an inclusive date range with their starts and ends clipped to it."""
    days = spark.range(1).select(F.to_date(F.lit(first)).alias("a"), F.to_date(F.lit(last)).alias("b"))
    months = days.select("a", "b", F.explode(F.expr("sequence(trunc(a, 'MM'), b, interval 1 month)")).alias("m"))
    return months.select(
        F.date_format("m", "yyyy-MM").alias("month"), F.greatest("a", "m").alias("from_date"), F.least("b", F.last_day("m")).alias("to_date")
    )


def grid_weight(returns: DataFrame, *, lo: float = 0.20, hi: float = 0.80, step: float = 0.05, fee: float = 0.002, keys: tuple[str, ...] = ("symbol", "month")) -> DataFrame:
    """The candidate weight with the best median - stdev / 2 of trade results; the lowest wins ties; no trades score -infinity.

    Candidates are exploded within each row (13 of them), so no join is needed.
    """
    count = round((hi - lo) / step) + 1
    grid = F.array(*(F.lit(round(lo + step * i, 4)) for i in range(count)))
    rows = returns.where("rn is not null and rs is not null").select(*keys, "rn", "rs", F.explode(grid).alias("w"))
    pnl = F.when(F.abs(F.col("w") * F.col("rs")) > 2 * fee, sign(F.col("w") * F.col("rs")) * F.col("rn") - 2 * fee)
    scored = rows.withColumn("pnl", pnl).groupBy(*keys, "w").agg(F.median("pnl").alias("m"), F.stddev_pop("pnl").alias("sd"), F.count("pnl").alias("n"))
    spread = F.when(F.col("n") == 1, F.abs(F.col("m"))).otherwise(F.col("sd"))
    scored = scored.withColumn("score", F.round(F.coalesce(F.col("m") - 0.5 * spread, F.lit(-1e300)), 12))
    best = latest(scored, list(keys), [F.col("score"), -F.col("w")])
    return best.select(*keys, F.col("w").alias("weight_backtest"), F.col("n").alias("trades"))


def weight_fusion(rows: DataFrame, *, lo: float = 0.20, hi: float = 0.80) -> DataFrame:
    wq = clamp(lo + (hi - lo) * F.col("score"), lo, hi)
    return rows.withColumn("weight_quality", wq).withColumn("weight_raw", 0.6 * F.col("weight_quality") + 0.4 * F.col("weight_backtest"))


def weight_shrinkage(rows: DataFrame, *, lo: float = 0.20, hi: float = 0.80, default: float = 0.5, prior_rows: int = 5000, min_rows: int, guard: float = 0.25) -> DataFrame:
    """Weights drawn to the median of passing rows by k = n / (n + prior); the guard weight for months that fail or are short.

    The median is one row that is joined on a constant key; it is never more than a row.
    """
    whole = rows.where("quality_pass").agg(F.median("weight_raw").alias("weight_global")).withColumn("_one", F.lit(1))
    k = F.col("overlap_rows") / (F.col("overlap_rows") + prior_rows)
    mixed = clamp(k * F.col("weight_raw") + (1 - k) * F.col("weight_global"), lo, hi)
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one", "left").drop("_one").withColumn("weight_global", F.coalesce("weight_global", F.lit(default)))
    return joined.withColumn("weight_final", F.when(F.col("quality_pass") & (F.col("overlap_rows") >= min_rows), mixed).otherwise(F.lit(guard)))


#: Fixed value: least overlap of a month that may be trained on, whatever the quality rule asks for.
LEAST_OVERLAP = 250


def eligibility(rows: DataFrame, *, min_rows: int, max_ape: float, least_rows: int = LEAST_OVERLAP) -> DataFrame:
    """Direct months; months without overlap carry the last direct one forward, else the next one backward; others are blocked.

    A direct month has a quarter of the quality rule's ``min_rows``, and ``least_rows`` in any case; series coarser than the
    15-minute grid that the default is made for pass one that their months can meet.
    """
    need = max(least_rows, max(1, min_rows // 4))
    direct = (F.col("overlap_rows") >= need) & (F.col("median_ape_close") <= max_ape) & (F.col("ret_corr") >= 0.30)
    w = Window.partitionBy("symbol").orderBy("month")
    anchor = F.when(direct, F.col("month"))
    before = F.last(anchor, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(anchor, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    empty = F.col("overlap_rows") == 0
    mode = F.when(direct, "direct").when(empty & before.isNotNull(), "carry_forward").when(empty & after.isNotNull(), "carry_backward").otherwise("blocked")
    base = F.when(direct, F.col("month")).when(empty, F.coalesce(before, after))
    return rows.withColumns({"eligibility_mode": mode, "anchor_month": base}).withColumn("supervised_eligible", F.col("eligibility_mode") != "blocked")


def latest_weight(weights: DataFrame) -> DataFrame:
    return latest(weights, ["symbol"], [F.col("month")])


def conversion_pass_rate(weights: DataFrame, quality: DataFrame, symbols: DataFrame, *, min_rows: int) -> DataFrame:
    """Share of eligible weight rows of the snapshot's symbols; without such rows, of passing quality rows with enough overlap,
    the one updated last for each (symbol, period); else null."""
    a = weights.join(symbols, "symbol", "left_semi").agg(F.avg(F.col("supervised_eligible").cast("double")).alias("a"))
    enough = quality.join(symbols, "symbol", "left_semi").where(F.col("overlap_rows") >= min_rows)
    b = latest(enough, ["symbol", "period"], [F.col("updated")]).agg(F.avg(F.col("quality_pass").cast("double")).alias("b"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(a).join(one(b), "_one").select(F.round(F.coalesce("a", "b"), 9).alias("pass_rate"))
