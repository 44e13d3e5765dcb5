"""Set-based trade evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import let, scan


def candidates(preds: DataFrame, *, scenario: str | None = None, threshold: float) -> DataFrame:
    """Rows of a scenario (or of the one that ``preds`` holds already) whose probability reaches the threshold."""
    rows = preds if scenario is None else preds.where(F.col("scenario") == scenario)
    return rows.where(F.col("probability") >= threshold)


def topk_per_bar(rows: DataFrame, *, k: int | Column, by: tuple[str, ...] = ("timestamp_ms",), score: str = "probability", tie: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The best k rows of a bar are accepted, others kept and tagged ``capacity``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("outcome", F.when(F.col("rank") <= k, "accepted").otherwise("capacity"))


def non_overlapping(rows: DataFrame, *, horizon_ms: int | Column, keys: tuple[str, ...] = ("symbol",), bucket_ms: int = 86_400_000) -> DataFrame:
    """Accepted entry times per key: a time is skipped while the last accepted one is still open (reopening at its exit).

    A bucket of times is a map from the time at which the last position is closed to that after the bucket, a step function: for a
    time up to the first entry of the bucket it is what that entry leads to, and so on; a later time passes unchanged.
    ``ordered.scan`` composes these over buckets, and each bucket is then gone through from what it is told. So a key is many
    tasks, and none has all its times. ``horizon_ms`` may be a column of ``keys``.
    """
    steps = "array<struct<upto:bigint,free:bigint>>"
    levels = ["_big", "_bucket"]
    keyed = rows.select(*keys, "timestamp_ms").withColumn("_bucket", F.floor(F.col("timestamp_ms") / bucket_ms).cast("bigint")).withColumn("_big", F.floor(F.col("_bucket") / 64).cast("bigint"))
    # Made distinct first: collecting sets goes over to sorting all rows once a task has more than a few groups.
    times = keyed.distinct().groupBy(*keys, *levels).agg(F.array_sort(F.collect_list("timestamp_ms")).alias("t"))
    horizon = F.lit(horizon_ms).cast("bigint") if isinstance(horizon_ms, int) else horizon_ms.cast("bigint")

    def at(m: Column, free: Column) -> Column:
        return F.coalesce(F.get(F.filter(m, lambda s: s["upto"] >= free), F.lit(0))["free"], free)

    def step(upto: Column, free: Column) -> Column:
        return F.struct(upto.alias("upto"), free.alias("free"))

    def compose(m: Column, n: Column) -> Column:
        led = F.transform(m, lambda s: step(s["upto"], at(n, s["free"])))
        last = F.coalesce(F.get(m, F.size(m) - 1)["upto"], F.lit(-(1 << 62)))
        later = F.filter(n, lambda s: s["upto"] > last)
        # Neighbours that lead to the same time are one step.
        return let(F.concat(led, later), lambda both: F.filter(both, lambda s, i: (i == F.size(both) - 1) | (F.get(both, i + 1)["free"] != s["free"])))

    none = F.array().cast(steps)
    built = F.aggregate(F.reverse("t"), none, lambda m, t: F.concat(F.array(step(t, at(m, t + horizon))), m))
    chunks = times.withColumn("_map", F.transform(built, lambda s: step(s["upto"].cast("bigint"), s["free"].cast("bigint"))))
    carry = scan(chunks.select(*keys, *levels, "_map"), list(keys), levels, "_map", none, compose)
    free = at(F.col("_carry"), F.lit(-(1 << 61)))
    start = F.struct(free.alias("free"), F.array().cast("array<bigint>").alias("out"))
    take = lambda s, t: F.when(t >= s["free"], F.struct((t + horizon).alias("free"), F.array_append(s["out"], t).alias("out"))).otherwise(s)
    taken = F.aggregate("t", start, take, lambda s: s["out"])
    return times.join(carry, [*keys, *levels]).select(*keys, F.explode(taken).alias("timestamp_ms"))


def trade_pnl(rows: DataFrame, *, notional: float, cost: float | Column) -> DataFrame:
    """Gross, net and net share of fixed-notional trades: paid n (1 + c), received n (1 + r)(1 - c)."""
    out = F.lit(notional) * (1 + F.col("forward_return")) * (1 - cost)
    debit = F.lit(notional) * (1 + cost)
    return rows.withColumns({"gross_pnl": notional * F.col("forward_return"), "net_pnl": out - debit, "net_pct": (out - debit) / debit})


def equity_curve(trades: DataFrame, *, capital: float, horizon_ms: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Realised equity at each exit time and the fall from its maximum. Trades are added up per time before the running sum."""
    per = trades.withColumn("exit_ms", F.col("timestamp_ms") + horizon_ms).groupBy(*keys, "exit_ms").agg(F.sum("net_pnl").alias("pnl"))
    return _equity(per, capital, keys)


def _equity(per: DataFrame, capital: float, keys: tuple[str, ...]) -> DataFrame:
    """``per`` has one row per key and exit time, so a window holds times, not trades."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = part.orderBy("exit_ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = per.withColumn("equity", capital + F.sum("pnl").over(w))
    top = F.greatest(F.lit(capital), F.max("equity").over(w))
    return rows.withColumn("drawdown_pct", (top - F.col("equity")) / top)


def monthly_returns(curve: DataFrame, *, capital: float) -> DataFrame:
    """Last equity of each month over that of the month before (the capital first)."""
    month = F.date_format(F.timestamp_millis("exit_ms"), "yyyy-MM")
    last = curve.groupBy(month.alias("month")).agg(F.max_by("equity", "exit_ms").alias("equity"))
    w = Window.partitionBy(F.lit(0)).orderBy("month")  # one row a month
    return last.withColumn("monthly_return", F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(capital)) - 1)


YEAR_MS = 365.25 * 86_400_000


def trade_summary(trades: DataFrame, curve: DataFrame, *, capital: float) -> DataFrame:
    """Totals, final equity, largest drawdown, and the annualised return if the span is at least a day and equity above 0."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    t = trades.agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"))
    c = curve.agg(F.max_by("equity", "exit_ms").alias("equity"), F.max("drawdown_pct").alias("max_drawdown_pct"), (F.max("exit_ms") - F.min("exit_ms")).alias("span"))
    return one(t).join(one(c), "_one").select("trades", "net_pnl", "win_rate", "equity", "max_drawdown_pct", _annualized(capital).alias("annualized_return"))


def _annualized(capital: float) -> Column:
    return F.when((F.col("span") >= 86_400_000) & (F.col("equity") > 0), F.pow(F.col("equity") / capital, YEAR_MS / F.col("span")) - 1)


def pnl_breakdown(trades: DataFrame) -> DataFrame:
    """By symbol and by source (the other column is ``*``)."""
    grains = trades.withColumn("g", F.explode(F.array(F.struct(F.col("symbol").alias("symbol"), F.lit("*").alias("source")), F.struct(F.lit("*").alias("symbol"), F.col("source").alias("source")))))
    return grains.groupBy(F.col("g.symbol").alias("symbol"), F.col("g.source").alias("source")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"), F.avg("net_pnl").alias("avg_pnl"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate")
    )


def sweep(preds: DataFrame, configs: list[tuple[float, int, float, int]], *, notional: float, capital: float, horizon_ms: int) -> DataFrame:
    """Trade evaluation for each configuration (threshold, k, cost, hold_ms), one row each.

    Candidates reach the threshold; of a symbol's, those while an earlier one is held are left out (``hold_ms`` 0: none); the best
    k of a bar are traded. Configurations are exploded within the rows and part of every key.
    """
    names = ("config", "threshold", "k", "cost", "hold_ms")
    items = F.array(*(F.struct(F.lit(i).alias("config"), F.lit(t).alias("threshold"), F.lit(k).alias("k"), F.lit(c).alias("cost"), F.lit(h).cast("bigint").alias("hold_ms")) for i, (t, k, c, h) in enumerate(configs)))
    rows = preds.withColumn("p", F.explode(items)).select(*preds.columns, "p.*").where(F.col("probability") >= F.col("threshold"))
    held = ("config", "hold_ms", "symbol")
    free = non_overlapping(rows.where("hold_ms > 0"), horizon_ms=F.col("hold_ms"), keys=held)
    open_ = rows.where("hold_ms > 0").join(free, [*held, "timestamp_ms"], "left_semi").unionByName(rows.where("hold_ms <= 0"))
    kept = topk_per_bar(open_, k=F.col("k"), by=("config", "timestamp_ms"), tie=("symbol", "row_key")).where("outcome = 'accepted'")
    made = trade_pnl(kept, notional=notional, cost=F.col("cost"))
    per = made.groupBy(*names, (F.col("timestamp_ms") + horizon_ms).alias("exit_ms")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("net_pnl") > 0).alias("wins"), F.sum("net_pnl").alias("pnl"))
    out = _equity(per, capital, names).groupBy(*names).agg(
        F.sum("n").alias("trades"), F.sum("pnl").alias("net_pnl"), (F.sum("wins") / F.sum("n")).alias("win_rate"), F.max_by("equity", "exit_ms").alias("equity"),
        F.max("drawdown_pct").alias("max_drawdown_pct"), (F.max("exit_ms") - F.min("exit_ms")).alias("span"),
    )
    return out.withColumn("annualized_return", _annualized(capital)).drop("span")
