"""Fill logs to positions, profit, violations and risk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import latest
from .ordered import prefix_sums
from .recurrence import linear_recurrence

FLAT = 1e-12


def _cells() -> list[Column]:
    """Fills of a symbol lie in cells of 512 numbers, 512 of which are a coarser cell."""
    return [F.floor(F.col("seq") / (1 << 18)).cast("bigint"), F.floor(F.col("seq") / (1 << 9)).cast("bigint")]


def _signed() -> Column:
    return F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))


def _cash() -> Column:
    value = F.col("qty") * F.col("price")
    return F.when(F.col("side") == "buy", -(value + F.col("fee"))).otherwise(value - F.col("fee"))


def _flat(q: Column) -> Column:
    return F.when(F.abs(q) <= FLAT, 0.0).otherwise(q)


def position_replay(fills: DataFrame) -> DataFrame:
    """Quantity, fee-capitalised average cost and realised profit after each fill.

    Quantity is a running sum. The cost basis C is a linear recurrence: a purchase adds qty * price + fee, a sale keeps the
    share 1 - f / q of it. Profit of a sale is proceeds - fee - average cost before it times the quantity sold. Both are put
    together over cells of fills, so that a symbol's fills are never ordered as a whole.
    """
    buy = F.col("side") == "buy"
    rows = prefix_sums(fills, ["symbol"], _cells(), ["seq"], {"_q": _signed()})
    rows = rows.withColumns({"_before": _flat(F.col("_q")), "position_qty": _flat(F.col("_q") + _signed())})
    a = F.when(buy, 1.0).when((F.col("position_qty") == 0) | (F.col("_before") <= 0), 0.0).otherwise(1 - F.col("qty") / F.col("_before"))
    b = F.when(buy, F.col("qty") * F.col("price") + F.col("fee")).otherwise(0.0)
    done = linear_recurrence(rows, ["symbol"], ["seq"], a, b, "_cost", span=512, before=True)
    avg_before = F.when(F.col("_before") > 0, F.col("_cost_before") / F.col("_before")).otherwise(0.0)
    pnl = F.when(~buy, F.col("qty") * F.col("price") - F.col("fee") - avg_before * F.col("qty")).otherwise(0.0)
    avg = F.when(F.col("position_qty") > 0, F.col("_cost") / F.col("position_qty")).otherwise(0.0)
    return done.withColumns({"avg_entry_price": avg, "realized_pnl": pnl, "cash_delta": _cash()}).drop("_q", "_before", "_cost", "_cost_before")


def fill_violations(fills: DataFrame, *, cash: float) -> DataFrame:
    """Oversold, non-positive quantity or price, negative fee, and negative cash (per symbol account), as rows."""
    rows = prefix_sums(fills, ["symbol"], _cells(), ["seq"], {"_q": _signed(), "_cash": _cash()})
    rules = F.array(
        F.when(F.col("_q") + _signed() < -FLAT, "oversell"),
        F.when(F.col("qty") <= 0, "quantity"),
        F.when(F.col("price") <= 0, "price"),
        F.when(F.col("fee") < 0, "fee"),
        F.when(cash + F.col("_cash") + _cash() < 0, "negative_cash"),
    )
    return rows.select("symbol", "seq", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("violation"))


def totals(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("fills"), F.sum("fee").alias("fees"), F.sum("realized_pnl").alias("realized_pnl"), F.sum("cash_delta").alias("cash_delta"), F.sum(F.col("qty") * F.col("price")).alias("notional")
    )


def position_times(fills: DataFrame) -> DataFrame:
    """Entry time (first purchase since the position was flat) and last exit (time of the last full close) per symbol."""
    rows = prefix_sums(fills, ["symbol"], _cells(), ["seq"], {"_q": _signed()})
    rows = rows.withColumn("_flat", (F.abs(F.col("_q") + _signed()) <= FLAT).cast("int"))
    island = prefix_sums(rows, ["symbol"], _cells(), ["seq"], {"_island": F.col("_flat")})
    per = island.groupBy("symbol", "_island").agg(F.min_by("filled_ms", F.when(F.col("side") == "buy", F.col("seq"))).alias("entry_ms"), F.max("_flat").alias("closed"), F.max_by("filled_ms", "seq").alias("end_ms"))
    agg = per.groupBy("symbol").agg(F.max_by(F.struct("entry_ms", "closed"), "_island").alias("x"), F.max_by("end_ms", F.when(F.col("closed") == 1, F.col("_island"))).alias("last_exit_ms"))
    return agg.select("symbol", F.when(F.col("x.closed") == 0, F.col("x.entry_ms")).alias("entry_ms"), "last_exit_ms")


def slippage(side: Column, reference: Column, price: Column) -> Column:
    """Share by which a fill was worse than the reference price; 0 where it was better or either price is not positive."""
    worse = F.when(side == "buy", price / reference - 1).otherwise(1 - price / reference)
    return F.when((reference > 0) & (price > 0), F.greatest(F.lit(0.0), worse)).otherwise(0.0)


def slippage_breach(share: Column, limit: float) -> Column:
    """Whether a fill was worse than the reference price by more than the allowed share."""
    return share > limit


def reconcile(positions: DataFrame, balances: DataFrame, *, now_ms: int, tolerance: float = 1e-9) -> DataFrame:
    """Positions against venue balances (amount - hold, floored at 0): the new quantity and how it came about."""
    b = balances.where(F.trim("symbol") != "").groupBy("symbol").agg(F.sum(F.col("amount") - F.col("hold")).alias("available"))
    j = positions.join(b, "symbol", "full")
    new, old = F.greatest(F.lit(0.0), F.coalesce("available", F.lit(0.0))), F.coalesce("qty", F.lit(0.0))
    action = F.when(F.abs(new - old) <= tolerance, "unchanged").when(new == 0, "closed").when(old == 0, "opened").otherwise("adjusted")
    avg = F.when(new == 0, 0.0).when((old == 0) | (F.coalesce("avg_entry_price", F.lit(0.0)) <= 0), F.col("reference_price")).otherwise(F.col("avg_entry_price"))
    return j.select("symbol", old.alias("old_qty"), new.alias("new_qty"), action.alias("action"), avg.alias("avg_entry_price"), F.when(action == "closed", F.lit(now_ms)).alias("exit_ms"))


def cap_cash(cash: Column, available: Column) -> Column:
    return F.when(cash <= available + 1e-9, cash).otherwise(F.greatest(F.lit(0.0), available))


def cap_books(books: DataFrame, balances: DataFrame) -> DataFrame:
    """Cash of each account's book against what the venue has available for it (amount - hold, added up, 0 if not listed)."""
    free = balances.groupBy("account").agg(F.sum(F.col("amount") - F.col("hold")).alias("available"))
    rows = books.join(free, "account", "left").withColumn("available", F.coalesce("available", F.lit(0.0)))
    new = cap_cash(F.col("cash"), F.col("available"))
    return rows.select("account", F.col("cash").alias("old_cash"), new.alias("new_cash"), (F.col("cash") > F.col("available") + 1e-9).alias("capped"))


def daily_pnl(replayed: DataFrame, *, cap: float) -> DataFrame:
    """Realised profit per UTC day, and whether it is at or below -cap."""
    day = F.date_format(F.timestamp_millis("filled_ms"), "yyyy-MM-dd")
    per = replayed.groupBy(day.alias("day")).agg(F.sum("realized_pnl").alias("realized_pnl"))
    return per.withColumn("breach", F.round("realized_pnl", 6) <= -cap)


def error_streaks(cycles: DataFrame, *, limit: int, warn: int = 2) -> DataFrame:
    """Running error count per cycle: failing cycles add theirs, successes and new days begin anew.

    Where ``cycles`` has a column ``breaches`` (fills of the cycle beyond the slippage guard), each counts as an error of its
    cycle, which is then no success, and the cycle halts at once.
    """
    breaches = F.coalesce(F.col("breaches"), F.lit(0)) if "breaches" in cycles.columns else F.lit(0)
    w = Window.partitionBy("runner", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    fine = F.col("ok") & (breaches == 0)
    rows = cycles.withColumn("_island", F.sum(fine.cast("int")).over(w))
    run = Window.partitionBy("runner", "day", "_island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.when(fine, 0).otherwise(F.when(F.col("ok"), 0).otherwise(F.col("errors")) + breaches)).over(run)
    rows = rows.withColumn("consecutive_errors", count)
    level = F.when((F.col("consecutive_errors") >= limit) | (breaches > 0), "halt").when(F.col("consecutive_errors") >= warn, "warn").otherwise("ok")
    return rows.select("runner", "day", "seq", "consecutive_errors", level.alias("level"))


def entry_sizing(candidates: DataFrame, *, spendable: float, fee: float, minimum: float) -> DataFrame:
    """Equal split of what can be spent over all candidates of a bar; below the minimum notional nothing is bought."""
    n = F.count(F.lit(1)).over(Window.partitionBy("timestamp_ms"))
    size = spendable / (n * (1 + fee))
    return candidates.withColumn("notional", F.when(size >= minimum, size).otherwise(0.0))


def fill_normalize(orders: DataFrame, statuses: DataFrame, *, fee_rate: float) -> DataFrame:
    """Order-status rows to fills: rows of the order's own id only, the latest one; quantity executed else ordered, price average
    else limit; a terminal state without fill is a rejection; sales are cut to the position."""
    positive = lambda x: F.when(x > 0, x)
    last = latest(statuses, ["order_id"], [F.col("seq")])
    j = orders.join(last, "order_id", "left")
    qty = F.coalesce(positive(F.col("executed_qty")), F.when(F.col("state") == "filled", positive(F.col("ordered_qty"))))
    price = F.coalesce(positive(F.col("avg_price")), positive(F.col("limit_price")))
    cut = F.when(F.col("side") == "sell", F.least(qty, F.col("position_qty"))).otherwise(qty)
    rows = j.withColumns({"fill_qty": cut, "fill_price": price})
    ok = (F.col("fill_qty") > 0) & F.col("fill_price").isNotNull()
    terminal = F.col("state").isin("rejected", "canceled", "expired", "filled")
    outcome = F.when(F.coalesce(ok, F.lit(False)), "fill").when(F.col("state").isNull(), "no_match").when(terminal, "rejected").otherwise("open")
    rows = rows.withColumn("outcome", outcome)
    filled = F.col("outcome") == "fill"
    return rows.select("order_id", "side", "outcome", F.when(filled, F.col("fill_qty")).alias("qty"), F.when(filled, F.col("fill_price")).alias("price"), F.when(filled, F.col("fill_qty") * F.col("fill_price") * fee_rate).alias("fee"))
