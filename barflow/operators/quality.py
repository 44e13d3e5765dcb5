"""Completeness and quality of bar series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..sources.tables import latest

DAY = 86_400_000


def gap_count(bars: DataFrame, *, interval_ms: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Missing steps between consecutive times per series."""
    w = Window.partitionBy(*keys).orderBy("timestamp_ms")
    steps = F.floor((F.lead("timestamp_ms").over(w) - F.col("timestamp_ms")) / interval_ms) - 1
    return bars.select(*keys, F.greatest(steps, F.lit(0)).alias("g")).groupBy(*keys).agg(F.coalesce(F.sum("g"), F.lit(0)).cast("bigint").alias("gap_count"))


def dup_misaligned(raw: DataFrame, *, interval_ms: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Times seen before, and times off the grid, over raw rows. Counted per (key, time) first, so hot keys spread."""
    per = raw.groupBy(*keys, "timestamp_ms").agg(F.count(F.lit(1)).alias("n"))
    off = F.when(F.col("timestamp_ms") % interval_ms != 0, F.col("n")).otherwise(0)
    return per.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("duplicate_count"), F.sum(off).alias("misaligned_count"))


def share_of(part: Column, whole: Column) -> Column:
    return clamp(part / F.greatest(F.lit(1), whole))


def coverage_report(bars: DataFrame, expected: DataFrame, *, interval_ms: int) -> DataFrame:
    """Per expected (dataset, symbol): status, extent, counts and shares; plus totals per dataset.

    ``expected`` tells whether a venue lists the symbol (``has_pair``) and whether its file exists (``has_file``): the status is
    ``no_pair``, ``missing_file``, ``empty`` for a file without rows, or ``ok``. One pass for gaps and one aggregate; the expected universe is joined from the left.
    """
    w = Window.partitionBy("dataset", "symbol").orderBy("timestamp_ms")
    steps = F.greatest(F.floor((F.lead("timestamp_ms").over(w) - F.col("timestamp_ms")) / interval_ms) - 1, F.lit(0))
    native = F.col("source").isin("native", "live")
    facts = (
        bars.withColumn("g", F.coalesce(steps, F.lit(0)))
        .groupBy("dataset", "symbol")
        .agg(
            F.min("timestamp_ms").alias("first_ts"),
            F.max("timestamp_ms").alias("last_ts"),
            F.count(F.lit(1)).alias("row_count"),
            F.sum("g").cast("bigint").alias("gap_count"),
            F.count_if(native).alias("native_rows"),
        )
    )
    joined = expected.join(facts, ["dataset", "symbol"], "left").fillna(0, ["row_count", "gap_count", "native_rows"])
    span = F.floor((F.col("last_ts") - F.col("first_ts")) / interval_ms) + 1
    rows = joined.select(
        "dataset",
        "symbol",
        F.when(~F.col("has_pair"), "no_pair").when(~F.col("has_file"), "missing_file").when(F.col("first_ts").isNull(), "empty").otherwise("ok").alias("status"),
        "first_ts",
        "last_ts",
        "row_count",
        "gap_count",
        F.round(F.coalesce(clamp(F.col("row_count") / span), F.lit(0.0)), 9).alias("coverage_pct"),
        F.round(share_of(F.col("native_rows"), F.col("row_count")), 9).alias("native_share"),
        F.round(share_of(F.col("row_count") - F.col("native_rows"), F.col("row_count")), 9).alias("synth_share"),
    )
    totals = rows.groupBy("dataset").agg(
        F.lit("*").alias("symbol"),
        F.when(F.count_if(F.col("status") != "ok") == 0, "ok").otherwise("partial").alias("status"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("row_count").alias("row_count"),
        F.sum("gap_count").alias("gap_count"),
        F.round(F.avg("coverage_pct"), 6).alias("coverage_pct"),
        F.round(F.avg("native_share"), 6).alias("native_share"),
        F.round(F.avg("synth_share"), 6).alias("synth_share"),
    )
    return rows.unionByName(totals)


def coverage_of_range(bars: DataFrame, *, start_ms: int, end_ms: int, interval_ms: int) -> DataFrame:
    """Rows in the requested range over the expected number."""
    expected = (end_ms - start_ms) // interval_ms
    inside = bars.where((F.col("timestamp_ms") >= start_ms) & (F.col("timestamp_ms") < end_ms))
    return inside.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(clamp(F.count(F.lit(1)) / expected), 9).alias("coverage_pct"))


def missing_windows(bars: DataFrame, *, start_ms: int, end_ms: int, interval_ms: int, max_days: int = 30) -> DataFrame:
    """Days lacking any expected bar, as runs of consecutive days of at most ``max_days``.

    Present bars are counted per (symbol, day): a day with fewer than expected is missing. No grid is laid out per bar.
    """
    first, last, per_day = start_ms // DAY, end_ms // DAY - 1, DAY // interval_ms
    on_grid = bars.where((F.col("timestamp_ms") >= start_ms) & (F.col("timestamp_ms") < end_ms) & (F.col("timestamp_ms") % interval_ms == 0))
    have = on_grid.groupBy("symbol", F.floor(F.col("timestamp_ms") / DAY).alias("day")).agg(F.count_distinct("timestamp_ms").alias("n"))
    days = bars.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    missing = days.join(have.where(F.col("n") >= per_day), ["symbol", "day"], "left_anti")
    w = Window.partitionBy("symbol").orderBy("day")
    island = missing.withColumn("island", F.col("day") - F.row_number().over(w))
    chunk = F.floor((F.row_number().over(Window.partitionBy("symbol", "island").orderBy("day")) - 1) / max_days)
    runs = island.withColumn("chunk", chunk).groupBy("symbol", "island", "chunk")
    return runs.agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count(F.lit(1)).alias("days")).drop("island", "chunk")


def ingest_summary(before: DataFrame, after: DataFrame, *, interval_ms: int) -> DataFrame:
    """Rows before and after, added rows, gaps and extent per series."""
    old = before.groupBy("venue", "symbol").agg(F.count(F.lit(1)).alias("rows_before"))
    new = after.groupBy("venue", "symbol").agg(F.count(F.lit(1)).alias("rows_after"), F.min("timestamp_ms").alias("first_ts"), F.max("timestamp_ms").alias("last_ts"))
    gaps = gap_count(after, interval_ms=interval_ms, keys=("venue", "symbol"))
    joined = new.join(old, ["venue", "symbol"], "left").join(gaps, ["venue", "symbol"]).fillna(0, ["rows_before"])
    return joined.withColumn("rows_added", F.col("rows_after") - F.col("rows_before"))


def quality_gate(report: DataFrame, *, max_gaps: int, min_coverage: float) -> DataFrame:
    """Violations: duplicates, misaligned rows; on the combined dataset also gaps and coverage. A job fails if any row is left."""
    combined = F.col("dataset") == "combined"
    rules = F.array(
        F.when(F.col("duplicate_count") > 0, "duplicates"),
        F.when(F.col("misaligned_count") > 0, "misaligned"),
        F.when(combined & (F.col("gap_count") > max_gaps), "gaps"),
        F.when(combined & (F.col("coverage_pct") < min_coverage), "coverage"),
    )
    return report.select("dataset", "symbol", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("violation"))


def warmup_coverage(bars: DataFrame, universe: DataFrame, *, slow: int, atr: int, min_share: float) -> DataFrame:
    """Share of symbols with enough distinct bars, and whether it suffices."""
    counts = bars.groupBy("symbol").agg(F.count_distinct("timestamp_ms").alias("n"))
    need = max(slow, atr) + 1
    joined = universe.join(counts, "symbol", "left")
    warm = F.count_if(F.coalesce(F.col("n"), F.lit(0)) >= need)
    return joined.agg(warm.alias("warm"), F.count(F.lit(1)).alias("symbols")).select(
        "warm", "symbols", (F.col("warm") / F.greatest(F.lit(1), F.col("symbols")) + 1e-12 >= min_share).alias("ok")
    )


def source_mix(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("rows"))


def content_hash(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Order-sensitive digest: rows hashed, then per (symbol, month) in time order, then per table.

    Two levels, so the table's digest needs no single sorted stream; its value is defined by these levels.
    """
    kinds = dict(rows.dtypes)
    text = [F.format_string("%.12f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    line = F.sha2(F.concat_ws("|", *(F.coalesce(t, F.lit("")) for t in text)), 256)
    month = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM")
    parts = rows.groupBy("symbol", month.alias("month")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp_ms", line.alias("h")))), lambda x: x["h"]), ""), 256).alias("h"), F.count(F.lit(1)).alias("n")
    )
    whole = F.array_sort(F.collect_list(F.struct("symbol", "month", "h")))
    return parts.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(whole, lambda x: x["h"]), ""), 256).alias("content_hash"))


def resolve_universe(instruments: DataFrame, wanted: DataFrame, *, quote: str, seq: str) -> DataFrame:
    """Wanted bases with their instrument (last one wins), or the reason why there is none."""
    ok = instruments.where((F.col("quote") == quote) & (F.col("instrument_id") > 0) & (F.trim("base") != "") & (F.trim("symbol") != ""))
    found = latest(ok.withColumn("base", F.upper(F.trim("base"))), ["base"], [F.col(seq)])
    joined = wanted.join(found.select("base", "symbol", "instrument_id"), "base", "left")
    return joined.withColumn("reason", F.when(F.col("instrument_id").isNull(), "not_listed"))


#: Quote currencies by preference.
QUOTES = ("CAD", "USD", "USDT", "USDC")
#: Base names that one venue lists differently.
ALIASES = {"BTC": "XBT", "DOGE": "XDG"}


def resolve_pairs(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The listed pair of each base whose quote comes first in ``QUOTES``; aliases of bases count as the base."""
    known = F.create_map(*[F.lit(x) for a, b in ALIASES.items() for x in (b, a)])
    rank = F.array_position(F.array(*map(F.lit, QUOTES)), F.col("quote"))
    listed = pairs.where((F.col("status") == "TRADING") & F.col("spot")).withColumn("base", F.coalesce(F.element_at(known, F.col("base")), F.col("base")))
    ranked = listed.withColumn("rank", rank).where("rank > 0")
    best = latest(ranked, ["base"], [-F.col("rank"), F.col("pair")])
    return wanted.join(best.select("base", "pair", "quote"), "base", "left")


def quote_currency(pair: Column) -> Column:
    """Longest known suffix of a pair's name, else its last three characters."""
    known = F.regexp_extract(F.upper(pair), "(USDT|USDC|CAD|USD|EUR|GBP|AUD)$", 1)
    return F.when(known != "", known).otherwise(F.right(F.upper(pair), F.lit(3)))


def quote_group(quote: Column) -> Column:
    return F.when(quote == "CAD", "CAD").otherwise("USD")
