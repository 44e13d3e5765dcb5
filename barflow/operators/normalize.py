"""Cross-source price normalisation: overlap observations, trimmed medians, nearest as-of rates, factors and fused bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite_positive, is_fill, month_key
from ..sources.tables import latest
from .ordered import order_statistics
from .quality import quote_group

BUCKET_MS = 86_400_000


def robust_median(rows: DataFrame, keys: list[str], value: str, alias: str = "value") -> DataFrame:
    """Trimmed median per key: below 8 values the median, else that of the middle 90 %. Exact.

    The median of the values at ranks lo to hi - 1 is the mean of the two in the middle (which may be one), so two order
    statistics say it all; they are located by counts of cells, and no key's values are ordered in one task.
    """

    def middle(n: Column) -> list[Column]:
        whole = n < 8
        lo = F.when(whole, F.lit(0)).otherwise(F.floor(n * 0.05))
        hi = F.when(whole, n).otherwise(F.greatest(lo + 1, F.floor(n * 0.95)))
        return [lo + F.floor((hi - lo - 1) / 2), lo + F.floor((hi - lo) / 2)]

    found = order_statistics(rows, keys, value, middle)
    return found.groupBy(*keys).agg(F.sum(0.5 * F.col(value)).alias(alias), F.first("n").alias(f"{alias}_rows"))


#: The account's currency, in which the native venue quotes.
HOME = "CAD"


def home_rate(rows: DataFrame, rate: Column) -> Column:
    """``rate``, but constantly 1 where the row's ``quote_currency`` is the account's own. Without such a column no quote is."""
    return F.when(F.upper("quote_currency") == HOME, 1.0).otherwise(rate) if "quote_currency" in rows.columns else rate


def exact_rate(rows: DataFrame, fx: DataFrame) -> DataFrame:
    """Rows with the ``rate`` of exactly their time, null where there is none; 1 for quotes in the account's currency."""
    return rows.join(fx.select("timestamp_ms", F.col("rate").alias("_fx")), "timestamp_ms", "left").withColumn("rate", home_rate(rows, F.col("_fx"))).drop("_fx")


def overlap_observations(native: DataFrame, external: DataFrame, fx: DataFrame) -> DataFrame:
    """Native and external closes of the same time (no gap fills): ratio, and basis where a rate exists at exactly that time."""
    ext = exact_rate(external.where(~is_fill(F.col("source"))), fx).select("venue", "symbol", "timestamp_ms", F.col("close").alias("ext_close"), "rate")
    both = native.select("symbol", "timestamp_ms", F.col("close").alias("native_close")).join(ext, ["symbol", "timestamp_ms"])
    both = both.where(finite_positive(F.col("native_close")) & finite_positive(F.col("ext_close")))
    ratio = F.col("native_close") / F.col("ext_close")
    return both.select(
        "venue", "symbol", "timestamp_ms", month_key(F.col("timestamp_ms")).alias("month"), "native_close", "ext_close",
        ratio.alias("ratio"), F.when(F.col("rate") > 0, ratio / F.col("rate")).alias("basis"),
    )


def conversion_context(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Trimmed medians of ratio and basis per (keys, month), and over all months (month null).

    Both grains and both values are kinds of one pass: every observation is laid out for each, not joined.
    """
    grains = obs.select(*keys, F.explode(F.array(F.col("month"), F.lit("*"))).alias("month"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("v")) for k in ("ratio", "basis")))).alias("o"))
    both = robust_median(grains.select(*keys, "month", "o.*"), [*keys, "month", "kind"], "v")
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = both.groupBy(*keys, "month").agg(*(of(k, c).alias(f"{k}_median{s}") for k in ("ratio", "basis") for c, s in (("value", ""), ("value_rows", "_rows"))))
    return wide.where("ratio_median is not null")


def asof_nearest(left: DataFrame, right: DataFrame, *, ts: str = "timestamp_ms", value: str = "rate", by: tuple[str, ...] = (), bucket_ms: int = BUCKET_MS, direction: str = "nearest", tolerance_ms: int | None = None) -> DataFrame:
    """Each left row with the right value nearest in time; ties go to the earlier one; no tolerance unless given.

    Windows are per (by, time bucket): each bucket gets the last value before it and the first after it as sentinels,
    found over the small table of buckets, so one long series is never one task. ``direction="backward"`` looks back only.
    """
    bucket = lambda df: df.withColumn("_b", F.floor(F.col(ts) / bucket_ms))
    lb, rb = bucket(left), bucket(right.select(*by, ts, F.col(value).alias("_v")))
    edges = rb.groupBy(*by, "_b").agg(
        F.min(F.struct(F.col(ts).alias("t"), F.col("_v").alias("v"))).alias("first"), F.max(F.struct(F.col(ts).alias("t"), F.col("_v").alias("v"))).alias("last")
    )
    slots = lb.select(*by, "_b").distinct().join(edges, [*by, "_b"], "full")
    order = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(0)).orderBy("_b")
    before = F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    sentinels = slots.withColumn("_s", F.array(before, after)).select(*by, "_b", F.explode("_s").alias("s")).where("s is not null").select(*by, "_b", F.col("s.t").alias(ts), F.col("s.v").alias("_v"))
    rates = rb.select(*by, "_b", ts, "_v").unionByName(sentinels)
    both = lb.withColumn("_left", F.lit(True)).unionByName(rates.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    pair = F.when(~F.col("_left"), F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")))
    # Both frames run from the partition's start, the second in descending order: a frame that is open to the end would be
    # evaluated anew for every row.
    so_far = lambda order: Window.partitionBy(*by, "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    back = F.last(pair, True).over(so_far(F.col(ts).asc()))
    ahead = F.last(pair, True).over(so_far(F.col(ts).desc()))
    found = both.withColumns({"_back": back, "_ahead": ahead}).where("_left")
    gap_back, gap_ahead = F.col(ts) - F.col("_back.t"), F.col("_ahead.t") - F.col(ts)
    use_back = F.col("_ahead.t").isNull() | (gap_back <= gap_ahead) if direction == "nearest" else F.lit(True)
    chosen = F.when(F.coalesce(use_back, F.lit(False)), F.col("_back.v")).otherwise(F.col("_ahead.v") if direction == "nearest" else F.lit(None))
    if tolerance_ms is not None:
        distance = F.when(F.coalesce(use_back, F.lit(False)), gap_back).otherwise(gap_ahead)
        chosen = F.when(distance <= tolerance_ms, chosen)
    return found.select(*left.columns, chosen.alias(value))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def conversion_factor(rate: Column, own: dict[str, Column], shared: dict[str, Column] | None = None) -> Column:
    """First positive of: rate times basis (month's, else global), month's ratio, global ratio; then the same of the shared context.

    A month's basis that is present but not positive does not fall through to the global basis.
    """

    def cascade(c: dict[str, Column]) -> list[Column]:
        return [positive(rate * F.coalesce(c["basis_month"], c["basis_global"])), positive(c["ratio_month"]), positive(c["ratio_global"])]

    return F.coalesce(*cascade(own), *(cascade(shared) if shared else []))


def with_factor(bars: DataFrame, context: DataFrame, fx: DataFrame, keys: list[str], prefix: str = "own") -> DataFrame:
    """Bars with the nearest rate and the context's medians as columns ``<prefix>_...``; contexts have one row a (key, month)."""
    names = {"ratio_median": "ratio", "basis_median": "basis"}
    monthly = context.where("month <> '*'").select(*keys, "month", *(F.col(a).alias(f"{prefix}_{b}_month") for a, b in names.items()))
    whole = context.where("month = '*'").select(*keys, *(F.col(a).alias(f"{prefix}_{b}_global") for a, b in names.items()))
    return bars.join(monthly, [*keys, "month"], "left").join(whole, keys, "left")


def columns_of(prefix: str) -> dict[str, Column]:
    return {f"{k}_{g}": F.col(f"{prefix}_{k}_{g}") for k in ("ratio", "basis") for g in ("month", "global")}


def select_source(candidates: DataFrame) -> DataFrame:
    """Best external venue per symbol: passes, then score to 9 places, then overlap, then priority (a low number)."""
    order = [F.col("quality_pass").cast("int"), F.round("score", 9), F.col("overlap_rows"), -F.col("priority")]
    return latest(candidates.where("rows > 0"), ["symbol"], order)


def shared_context(obs: DataFrame, selection: DataFrame) -> DataFrame:
    """``conversion_context`` of quote groups: the observations of each symbol's selected venue, pooled by the group of its quote.

    ``selection(symbol, venue, quote_currency)`` has one row a symbol.
    """
    chosen = selection.select("symbol", "venue", quote_group(F.upper("quote_currency")).alias("quote_group"))
    return conversion_context(obs.join(chosen, ["symbol", "venue"]), ["quote_group"])


def factors(external: DataFrame, context: DataFrame, fx: DataFrame, keys: list[str], shared: DataFrame | None = None) -> DataFrame:
    """External bars with ``rate`` and ``factor``; with a ``shared`` context bars whose own one has nothing fall back on that of
    their quote group, so that symbols without native history are converted too."""
    rated = asof_nearest(external.withColumn("month", month_key(F.col("timestamp_ms"))), fx)
    rated = with_factor(rated.withColumn("rate", home_rate(external, F.col("rate"))), context, fx, keys)
    own = rated.withColumn("factor", conversion_factor(F.col("rate"), columns_of("own")))
    return own if shared is None else with_shared(own, shared, fx)


def with_shared(factored: DataFrame, shared: DataFrame, fx: DataFrame) -> DataFrame:
    """Bars of ``factors`` whose own factor is missing take that of their quote group's shared context."""
    grouped = factored.withColumn("quote_group", quote_group(F.upper("quote_currency")))
    both = with_factor(grouped, shared, fx, ["quote_group"], "shared")
    return both.withColumn("factor", F.coalesce("factor", conversion_factor(F.col("rate"), columns_of("shared"))))


PRICES = ("open", "high", "low", "close")


def combined_bars(native: DataFrame, primary: DataFrame, fallback: DataFrame, *, interval_ms: int) -> DataFrame:
    """Native bars, else the chosen venue's times its factor, else the fallback's times its own; other times are absent.

    ``primary`` and ``fallback`` carry ``factor``; rows without a positive one don't count. Volume is not scaled. Times off
    the grid are dropped. The three sources are united and ranked per (symbol, time), so that one shuffle does it all.
    """

    def part(df: DataFrame, rank: int) -> DataFrame:
        f = F.lit(1.0) if rank == 0 else F.col("factor")
        tag = F.col("source") if rank == 0 else F.when(is_fill(F.col("source")), "synthetic_fill").otherwise("synthetic")
        rows = df if rank == 0 else df.where(finite_positive(F.col("factor")))
        return rows.select("symbol", "timestamp_ms", *((F.col(c) * f).alias(c) for c in PRICES), "volume", tag.alias("source"), F.lit(rank).alias("_rank"))

    parts = [part(df, k) for k, df in enumerate((native, primary, fallback))]
    rows = reduce(DataFrame.unionByName, parts).where(F.col("timestamp_ms") % interval_ms == 0)
    best = F.min_by(F.struct(*PRICES, "volume", "source"), "_rank")
    return rows.groupBy("symbol", "timestamp_ms").agg(best.alias("b")).select("symbol", "timestamp_ms", "b.*")


def combined_summary(combined: DataFrame, native: DataFrame, external: DataFrame, universe: DataFrame, *, interval_ms: int) -> DataFrame:
    """Counts, shares, gaps and status per symbol; external times are the union of primary and fallback times."""
    from .quality import gap_count

    counts = combined.groupBy("symbol").agg(F.count(F.lit(1)).alias("combined_rows"), F.count_if(F.col("source") == "native").alias("native_in"))
    n = native.groupBy("symbol").agg(F.count_distinct("timestamp_ms").alias("native_rows"))
    e = external.groupBy("symbol").agg(F.count_distinct("timestamp_ms").alias("external_rows"))
    joined = reduce(lambda a, b: a.join(b, "symbol", "left"), (universe, counts, n, e, gap_count(combined, interval_ms=interval_ms)))
    joined = joined.fillna(0, ["combined_rows", "native_in", "native_rows", "external_rows", "gap_count"])
    share = F.col("native_in") / F.greatest(F.lit(1), F.col("combined_rows"))
    status = F.when(F.col("combined_rows") == 0, "empty").when(F.col("gap_count") > 0, "warning").otherwise("ok")
    return joined.select(
        "symbol", "native_rows", "external_rows", "combined_rows", "gap_count",
        F.round(share, 9).alias("native_share"), F.round(F.when(F.col("combined_rows") > 0, 1 - share).otherwise(0.0), 9).alias("synth_share"), status.alias("status"),
    )
