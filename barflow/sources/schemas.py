"""Table schemas: all times are epoch milliseconds, UTC; a bar is labelled by its close time."""

#: The columns of bars, ticks and tick files.
BARS = (
    "symbol string, timestamp_ms bigint, open double, high double, low double, close double, volume double, "
    "inside_bid double, inside_ask double, instrument_id bigint, interval_seconds int, source string"
)
TICKS = "symbol string, ts_ms bigint, price double, volume double, seq bigint"
TICK_CSV = "ts_seconds double, price double, volume double"
#: What a lenient scan puts for a missing column or a null.
BAR_DEFAULTS = {
    "open": 0.0, "high": 0.0, "low": 0.0, "close": 0.0, "volume": 0.0, "inside_bid": 0.0, "inside_ask": 0.0, "instrument_id": 0,
}
