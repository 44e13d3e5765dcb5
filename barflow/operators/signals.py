"""Rule-based signals from exponential means and true range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nonzero
from .recurrence import ema_map, means, wilder, wilder_map


def true_range(bars: DataFrame) -> DataFrame:
    """Largest of the bar's range and its distances to the previous close; the first bar's previous close is its own."""
    w = Window.partitionBy("symbol").orderBy("timestamp_ms")
    prev = F.coalesce(F.lag("close").over(w), F.col("close"))
    return bars.withColumn("_prev", prev).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev")))).drop("_prev")


def indicators(bars: DataFrame, *, fast: int, slow: int, atr: int) -> DataFrame:
    """Both exponential means of the close and Wilder's mean of the true range, in one scan."""
    maps = {"ema_fast": ema_map("close", fast), "ema_slow": ema_map("close", slow), "atr": wilder_map("tr", atr)}
    return means(true_range(bars), ["symbol"], ["timestamp_ms"], maps)


def indicator_snapshot(bars: DataFrame, *, fast: int, slow: int, atr: int) -> DataFrame:
    """The latest indicators per symbol; null where there are fewer bars than the longest period."""
    rows = indicators(bars, fast=fast, slow=slow, atr=atr)
    agg = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("timestamp_ms", "close", "ema_fast", "ema_slow", "atr"), "timestamp_ms").alias("x"))
    enough = F.col("n") >= max(fast, slow, atr)
    return agg.select("symbol", F.col("x.timestamp_ms").alias("timestamp_ms"), *(F.when(enough, F.col(f"x.{c}")).alias(c) for c in ("close", "ema_fast", "ema_slow", "atr")))


def entry_signals(snapshot: DataFrame, positions: DataFrame, *, now_ms: int, cooldown_ms: int) -> DataFrame:
    """First reason that applies decides; a symbol without a position row is flat."""
    #: The names of the reasons, here and below.
    j = snapshot.join(positions, "symbol", "left")
    cooling = F.col("last_exit_ms").isNotNull() & (now_ms - F.col("last_exit_ms") < cooldown_ms)
    reason = (
        F.when(F.col("ema_slow").isNull(), "insufficient_data")
        .when(F.coalesce("qty", F.lit(0.0)) > 0, "position_open")
        .when(cooling, "cooldown_active")
        .when(F.col("ema_fast") <= F.col("ema_slow"), "trend_not_up")
        .when(F.col("close") >= F.col("ema_fast"), "no_pullback")
        .otherwise("entry_conditions_met")
    )
    score = (F.col("ema_fast") - F.col("ema_slow")) / nonzero(F.col("close"))
    rows = j.withColumn("reason", reason)
    return rows.select("symbol", F.when(F.col("reason") == "entry_conditions_met", "ENTER").otherwise("HOLD").alias("signal"), "reason", F.coalesce(score, F.lit(0.0)).alias("score"))


def exit_signals(snapshot: DataFrame, positions: DataFrame, *, now_ms: int, stop_k: float, max_hold_ms: int) -> DataFrame:
    j = snapshot.join(positions, "symbol", "left")
    old = F.col("entry_ms").isNotNull() & (now_ms - F.col("entry_ms") >= max_hold_ms)
    reason = (
        F.when(F.col("ema_slow").isNull(), "insufficient_data")
        .when(F.coalesce("qty", F.lit(0.0)) <= 0, "no_position")
        .when(F.col("ema_fast") < F.col("ema_slow"), "trend_break")
        .when(F.col("close") < F.col("avg_entry_price") - stop_k * F.col("atr"), "atr_stop")
        .when(old, "time_stop")
        .otherwise("hold_position")
    )
    rows = j.withColumn("reason", reason)
    return rows.select("symbol", F.when(F.col("reason").isin("trend_break", "atr_stop", "time_stop"), "EXIT").otherwise("HOLD").alias("signal"), "reason")


def entry_cap(entries: DataFrame, *, n: int) -> DataFrame:
    """The best n entries by (score, symbol); others hold. Entries of one cycle only, one row a symbol."""
    # only entries are ranked among each other; every other row is a partition of its own symbol
    w = Window.partitionBy(F.when(F.col("signal") == "ENTER", "*").otherwise(F.col("symbol"))).orderBy(F.desc("score"), "symbol")
    over = (F.col("signal") == "ENTER") & (F.row_number().over(w) > n)
    rows = entries.withColumn("_over", over)
    return rows.select("symbol", F.when(F.col("_over"), "HOLD").otherwise(F.col("signal")).alias("signal"), F.when(F.col("_over"), "entry_cap_reached").otherwise(F.col("reason")).alias("reason"), "score")


def decisions(entries: DataFrame, exits: DataFrame) -> DataFrame:
    """One decision a symbol: an exit signal, else the entry's."""
    e = exits.select("symbol", F.col("signal").alias("_xs"), F.col("reason").alias("_xr"))
    leave = F.col("_xs") == "EXIT"
    return entries.join(e, "symbol").select("symbol", F.when(leave, "EXIT").otherwise(F.col("signal")).alias("signal"), F.when(leave, F.col("_xr")).otherwise(F.col("reason")).alias("reason"), "score")
