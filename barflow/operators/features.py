"""Rolling features per symbol: row-count windows over one ordering, null until a window is full unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, nonzero
from .recurrence import ema_map, means

#: The windows, in rows, of the feature set.
RETURNS, WINDOWS, RSI = (1, 4, 16, 48, 96), (4, 16, 48, 96), (14, 28)
EMA_PAIRS = ((8, 32), (16, 64), (32, 128))


def ordering():
    """Built when used: a window needs a session."""
    return Window.partitionBy("symbol").orderBy("timestamp_ms")


def frame(n: int):
    return ordering().rowsBetween(-(n - 1), 0)


def full(agg: Column, x: Column, n: int) -> Column:
    """``agg`` where the frame holds n values."""
    return F.when(F.count(x).over(frame(n)) == n, agg)


def clean(x: Column) -> Column:
    """Float32; null and non-finite values are 0."""
    return F.when(finite(x), x).otherwise(0.0).cast("float")


def n_bar_return(x: str, n: int) -> Column:
    return F.col(x) / nonzero(F.lag(x, n).over(ordering())) - 1


def rolling_mean(x: Column, n: int) -> Column:
    return full(F.avg(x).over(frame(n)), x, n)


def rolling_std(x: Column, n: int) -> Column:
    return full(F.stddev_pop(x).over(frame(n)), x, n)


def with_base(rows: DataFrame, close: str = "close") -> DataFrame:
    """1-bar return and difference, which the windows need as columns."""
    return rows.withColumns({"_r": n_bar_return(close, 1), "_d": F.col(close) - F.lag(close).over(ordering())})


def returns(close: str = "close", prefix: str = "combined_ret", ns: tuple[int, ...] = RETURNS) -> dict[str, Column]:
    return {f"{prefix}_{n}": n_bar_return(close, n) for n in ns}


def trend() -> dict[str, Column]:
    return {f"combined_trend_{n}": rolling_mean(F.col("_r"), n) for n in WINDOWS}


def volatility() -> dict[str, Column]:
    return {f"combined_vol_{n}": rolling_std(F.col("_r"), n) for n in WINDOWS}


def volume() -> dict[str, Column]:
    return {f"volume_ratio_{n}": F.col("volume") / nonzero(rolling_mean(F.col("volume"), n)) for n in WINDOWS}


def rsi() -> dict[str, Column]:
    """Simple-mean variant; without losses null."""

    def one(n: int) -> Column:
        gain, loss = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
        mean = lambda x: F.avg(F.when(F.col("_d").isNotNull(), x)).over(frame(n))
        return full(100 - 100 / (1 + mean(gain) / nonzero(mean(loss))), F.col("_d"), n)

    return {f"rsi_{n}": one(n) for n in RSI}


def distance() -> dict[str, Column]:
    c = F.col("close")
    out = {f"dist_mean_{n}": c / nonzero(rolling_mean(c, n)) - 1 for n in WINDOWS[1:]}
    return out | {f"zscore_{n}": (c - rolling_mean(c, n)) / nonzero(rolling_std(c, n)) for n in WINDOWS[1:]}


def source_flags() -> dict[str, Column]:
    s = F.col("source")
    flag = lambda c: c.cast("double")
    synthetic, fill = s.isin("synthetic", "synthetic_fill").cast("double"), (s == "synthetic_fill").cast("double")
    out = {"is_native": flag(s == "native"), "is_synthetic": flag(s == "synthetic"), "is_synthetic_gap_fill": flag(s == "synthetic_fill")}
    out |= {f"synthetic_share_{n}": F.avg(synthetic).over(frame(n)) for n in WINDOWS[1:]}
    return out | {f"gap_fill_count_{n}": F.sum(fill).over(frame(n)) for n in WINDOWS[1:]}


def context_columns(rows: DataFrame, series: DataFrame, name: str) -> DataFrame:
    """Exact-time left join of a close series ``(symbol, timestamp_ms, close)`` as column ``name``."""
    return rows.join(series.select("symbol", "timestamp_ms", F.col("close").alias(name)), ["symbol", "timestamp_ms"], "left")


def external(close: str = "ext_close") -> dict[str, Column]:
    r = F.col("_er")
    out = returns(close, "external_ret", (1, 4, 16)) | {"external_absret_1": F.abs(r)}
    return out | {f"external_vol_{n}": rolling_std(r, n) for n in (4, 16)}


def native(close: str = "native_close") -> dict[str, Column]:
    here = F.col(close).isNotNull().cast("double")
    return returns(close, "native_ret", (1, 4, 16)) | {f"native_present_{n}": F.avg(here).over(frame(n)) for n in (1, 4, 16)}


def basis() -> dict[str, Column]:
    """Level where all three prices are above 0; z-score where a frame of 96 rows holds 96 levels."""
    b = F.col("_basis")
    z = (b - rolling_mean(b, 96)) / nonzero(rolling_std(b, 96))
    present = lambda c: F.col(c).isNotNull().cast("double")
    return {
        "basis_level": b, "basis_zscore_96": z, "external_ctx_available": present("ext_close"),
        "native_ctx_available": present("native_close"), "basis_available": b.isNotNull().cast("double"),
    }


def basis_level(fx: Column) -> Column:
    n, e = F.col("native_close"), F.col("ext_close")
    return F.when((n > 0) & (e > 0) & (fx > 0), n / (e * fx))


def ema_ratios(rows: DataFrame) -> DataFrame:
    """Fast over slow exponential mean - 1, null before as many rows as the slow span; one scan for all spans."""
    spans = sorted({s for p in EMA_PAIRS for s in p})
    out = means(rows, ["symbol"], ["timestamp_ms"], {f"_ema_{s}": ema_map("close", s) for s in spans})
    n = F.row_number().over(ordering())
    ratio = lambda a, b: F.when(n >= b, F.col(f"_ema_{a}") / nonzero(F.col(f"_ema_{b}")) - 1)
    return out.withColumns({f"ema_ratio_{a}_{b}": ratio(a, b) for a, b in EMA_PAIRS}).drop(*(f"_ema_{s}" for p in EMA_PAIRS for s in p))


WEIGHT_FEATURES = {"effective_monthly_weight": "effective_monthly_weight", "supervised_row_weight": "supervised_row_weight_feature"}


def feature_table(rows: DataFrame, external_close: DataFrame, native_close: DataFrame, rates: DataFrame, *, with_ema: bool = True) -> DataFrame:
    """All features as float32 with 0 for nulls, over all rows; then only the trainable ones. One ordering serves all windows.

    ``rates(symbol, timestamp_ms, close)`` is the currency rate of each symbol's external quote, taken at exactly the row's time.
    """
    wide = context_columns(context_columns(rows, external_close, "ext_close"), native_close, "native_close")
    wide = context_columns(wide, rates, "fx_rate")
    if with_ema:
        wide = ema_ratios(wide)
    wide = with_base(wide).withColumns({"_er": n_bar_return("ext_close", 1), "_basis": basis_level(F.col("fx_rate"))})
    columns = returns() | trend() | volatility() | volume() | rsi() | distance() | source_flags() | external() | native() | basis()
    # The weights are features too, the row's own under another name than the weight that fits use.
    columns |= {new: F.col(old).cast("double") for old, new in WEIGHT_FEATURES.items() if old in rows.columns and new not in rows.columns}
    made = wide.withColumns(columns)
    weights = [new for old, new in WEIGHT_FEATURES.items() if old in rows.columns]
    names = [*dict.fromkeys([*columns, *weights]), *(f"ema_ratio_{a}_{b}" for a, b in EMA_PAIRS if with_ema)]
    keep = [c for c in ("symbol", "timestamp_ms", "source", "y", "forward_return", "supervised_row_weight") if c in rows.columns]
    return made.where("row_status = 'trainable'").select(*keep, *(clean(F.col(n)).alias(n) for n in names))
