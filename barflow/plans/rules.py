"""Rule-based signals, ledgers and risk tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import signals as K
from ..operators.recurrence import ema as ema_scan
from ..sources import fixtures as X
from ..sources import tables as A
from ..sources.staging import staged
from . import ORACLES, QUERIES, VIEWS, query

DAY, FAST, SLOW, ATR = X.DAY, 12, 48, 14
NOW = 1_005_000_000_000

VIEWS |= {
    "kbars": "SELECT symbol, timestamp_ms, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms) AS n FROM vbars WHERE venue = 'native'",
    "ktr": """SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY n), close) AS pc FROM kbars)""",
    "kind": f"""SELECT symbol, n, timestamp_ms, close, close AS ema_fast, close AS ema_slow, tr AS atr FROM ktr WHERE n = 1 UNION ALL SELECT t.symbol, t.n, t.timestamp_ms, t.close,
      (1 - 2::DOUBLE / {FAST + 1}) * k.ema_fast + 2::DOUBLE / {FAST + 1} * t.close, (1 - 2::DOUBLE / {SLOW + 1}) * k.ema_slow + 2::DOUBLE / {SLOW + 1} * t.close, {ATR - 1}::DOUBLE / {ATR} * k.atr + t.tr / {ATR}
      FROM kind k JOIN ktr t ON t.symbol = k.symbol AND t.n = k.n + 1""",
    "ksnap": f"SELECT symbol, timestamp_ms, CASE WHEN n >= {SLOW} THEN close END AS close, CASE WHEN n >= {SLOW} THEN ema_fast END AS ema_fast, CASE WHEN n >= {SLOW} THEN ema_slow END AS ema_slow, CASE WHEN n >= {SLOW} THEN atr END AS atr FROM kind WHERE (symbol, n) IN (SELECT (symbol, max(n)) FROM kbars GROUP BY symbol)",
    "uni": """SELECT s.symbol || '-' || s_suppkey AS symbol, timestamp_ms, close * (1 + (s_suppkey % 11 - 5) / 500::DOUBLE) AS close, ema_fast, ema_slow * (1 + (s_suppkey % 7 - 3) / 1000::DOUBLE) AS ema_slow, atr FROM supplier JOIN ksnap s ON s.symbol = 'S' || (s_suppkey % 4)""",
    "pos": f"""SELECT 'S' || (s_suppkey % 4) || '-' || s_suppkey AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 2::DOUBLE ELSE 0 END AS qty, 90::DOUBLE + s_suppkey % 40 AS avg_entry_price,
      CASE WHEN s_suppkey % 3 = 0 THEN {NOW} - (s_suppkey % 9) * {DAY} END AS entry_ms, CASE WHEN s_suppkey % 5 = 0 THEN {NOW} - (s_suppkey % 4) * 3600000 END AS last_exit_ms FROM supplier WHERE s_suppkey % 10 <> 7""",
    "entries": f"""SELECT symbol, CASE WHEN reason = 'entry_conditions_met' THEN 'ENTER' ELSE 'HOLD' END AS signal, reason, score FROM (SELECT symbol, coalesce((ema_fast - ema_slow) / nullif(close, 0), 0) AS score, CASE WHEN ema_slow IS NULL THEN 'insufficient_data' WHEN coalesce(qty, 0) > 0 THEN 'position_open'
      WHEN last_exit_ms IS NOT NULL AND {NOW} - last_exit_ms < {2 * 3600000} THEN 'cooldown_active' WHEN ema_fast <= ema_slow THEN 'trend_not_up' WHEN close >= ema_fast THEN 'no_pullback' ELSE 'entry_conditions_met' END AS reason FROM uni LEFT JOIN pos USING (symbol))""",
    "exits": f"""SELECT symbol, CASE WHEN reason IN ('trend_break', 'atr_stop', 'time_stop') THEN 'EXIT' ELSE 'HOLD' END AS signal, reason FROM (SELECT symbol, CASE WHEN ema_slow IS NULL THEN 'insufficient_data' WHEN coalesce(qty, 0) <= 0 THEN 'no_position'
      WHEN ema_fast < ema_slow THEN 'trend_break' WHEN close < avg_entry_price - 2 * atr THEN 'atr_stop' WHEN entry_ms IS NOT NULL AND {NOW} - entry_ms >= {4 * DAY} THEN 'time_stop' ELSE 'hold_position' END AS reason FROM uni LEFT JOIN pos USING (symbol))""",
    "capped": """SELECT symbol, CASE WHEN signal = 'ENTER' AND rk > 5 THEN 'HOLD' ELSE signal END AS signal, CASE WHEN signal = 'ENTER' AND rk > 5 THEN 'entry_cap_reached' ELSE reason END AS reason, score
      FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, symbol) AS rk FROM entries)""",
    "fq": """SELECT *, CASE WHEN abs(q) <= 1e-12 THEN 0 ELSE q END AS position_qty FROM (SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS q FROM fills)""",
    "fcost": """SELECT symbol, seq, position_qty, CASE WHEN side = 'buy' THEN qty * price + fee ELSE 0 END AS cost, 0::DOUBLE AS before_cost, 0::DOUBLE AS before_qty FROM fq WHERE seq = 1
      UNION ALL SELECT f.symbol, f.seq, f.position_qty, CASE WHEN f.side = 'buy' THEN c.cost + f.qty * f.price + f.fee WHEN f.position_qty = 0 OR c.position_qty <= 0 THEN 0 ELSE c.cost * (1 - f.qty / c.position_qty) END, c.cost, c.position_qty
      FROM fcost c JOIN fq f ON f.symbol = c.symbol AND f.seq = c.seq + 1""",
    "replay": """SELECT f.symbol, f.seq, f.side, f.qty, f.price, f.fee, f.filled_ms, f.position_qty, CASE WHEN f.position_qty > 0 THEN c.cost / f.position_qty ELSE 0 END AS avg_entry_price,
      CASE WHEN f.side = 'sell' THEN f.qty * f.price - f.fee - CASE WHEN before_qty > 0 THEN before_cost / before_qty ELSE 0 END * f.qty ELSE 0 END AS realized_pnl, CASE WHEN f.side = 'buy' THEN -(f.qty * f.price + f.fee) ELSE f.qty * f.price - f.fee END AS cash_delta
      FROM fq f JOIN fcost c ON c.symbol = f.symbol AND c.seq = f.seq""",
    "badfills": "SELECT symbol, seq, side, CASE WHEN seq % 97 = 0 THEN -qty WHEN seq % 31 = 0 THEN qty * 500 ELSE qty END AS qty, CASE WHEN seq % 89 = 0 THEN 0 ELSE price END AS price, CASE WHEN seq % 83 = 0 THEN -fee - 1 ELSE fee END AS fee FROM fills",
}


class Rules:
    def __init__(self, spark, sf: str) -> None:
        self.spark, self.sf = spark, sf

    @cached_property
    def bars(self) -> DataFrame:
        return X.vbars(self.spark, self.sf).where("venue = 'native'").select("symbol", "timestamp_ms", "high", "low", "close")

    @cached_property
    def suppliers(self) -> DataFrame:
        return A.read_table(self.spark, self.sf, "supplier")

    @cached_property
    def snapshot(self) -> DataFrame:
        """Indicators of each supplier's series: a symbol's latest, shifted by the supplier's number."""
        latest = K.indicator_snapshot(self.bars, fast=FAST, slow=SLOW, atr=ATR)
        mine = self.suppliers.selectExpr("s_suppkey", "concat('S', s_suppkey % 4) as symbol")
        return staged(
            mine.join(latest, "symbol").selectExpr(
                "concat(symbol, '-', s_suppkey) as symbol", "timestamp_ms", "close * (1 + (s_suppkey % 11 - 5) / 500D) as close", "ema_fast", "ema_slow * (1 + (s_suppkey % 7 - 3) / 1000D) as ema_slow", "atr"
            )
        )

    @cached_property
    def positions(self) -> DataFrame:
        return self.suppliers.where("s_suppkey % 10 <> 7").selectExpr(
            "concat('S', s_suppkey % 4, '-', s_suppkey) as symbol", "if(s_suppkey % 3 = 0, 2D, 0D) as qty", "90D + s_suppkey % 40 as avg_entry_price",
            f"if(s_suppkey % 3 = 0, {NOW} - (s_suppkey % 9) * {DAY}, null) as entry_ms", f"if(s_suppkey % 5 = 0, {NOW} - (s_suppkey % 4) * 3600000, null) as last_exit_ms",
        )

    @cached_property
    def entries(self) -> DataFrame:
        return K.entry_signals(self.snapshot, self.positions, now_ms=NOW, cooldown_ms=2 * 3_600_000)

    @cached_property
    def exits(self) -> DataFrame:
        return K.exit_signals(self.snapshot, self.positions, now_ms=NOW, stop_k=2.0, max_hold_ms=4 * DAY)

    @cached_property
    def fills(self) -> DataFrame:
        return staged(X.fills(self.spark, self.sf))

    @cached_property
    def replay(self) -> DataFrame:
        return L.position_replay(self.fills)


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


@query("SELECT symbol, timestamp_ms, round(ema_fast, 6) AS ema FROM kind")
def ema(spark, sf):
    return six(ema_scan(Rules(spark, sf).bars, ["symbol"], ["timestamp_ms"], "close", FAST, "ema").select("symbol", "timestamp_ms", "ema"), "ema")


@query("SELECT symbol, timestamp_ms, round(tr, 6) AS tr FROM ktr")
def true_range(spark, sf):
    return six(K.true_range(Rules(spark, sf).bars).select("symbol", "timestamp_ms", "tr"), "tr")


@query("SELECT symbol, timestamp_ms, round(atr, 6) AS atr FROM kind")
def wilder_atr(spark, sf):
    rows = K.wilder(K.true_range(Rules(spark, sf).bars), ["symbol"], ["timestamp_ms"], "tr", ATR, "atr")
    return six(rows.select("symbol", "timestamp_ms", "atr"), "atr")


@query("SELECT symbol, timestamp_ms, round(close, 6) AS close, round(ema_fast, 6) AS ema_fast, round(ema_slow, 6) AS ema_slow, round(atr, 6) AS atr FROM ksnap")
def indicator_snapshot(spark, sf):
    return six(K.indicator_snapshot(Rules(spark, sf).bars, fast=FAST, slow=SLOW, atr=ATR), "close", "ema_fast", "ema_slow", "atr")


@query("SELECT symbol, signal, reason, round(score, 6) AS score FROM entries")
def entry_signals(spark, sf):
    return six(Rules(spark, sf).entries, "score")


@query("SELECT * FROM exits")
def exit_signals(spark, sf):
    return Rules(spark, sf).exits


@query("SELECT symbol, signal, reason, round(score, 6) AS score FROM capped")
def entry_cap(spark, sf):
    return six(K.entry_cap(Rules(spark, sf).entries, n=5), "score")


@query("SELECT c.symbol, CASE WHEN x.signal = 'EXIT' THEN 'EXIT' ELSE c.signal END AS signal, CASE WHEN x.signal = 'EXIT' THEN x.reason ELSE c.reason END AS reason, round(score, 6) AS score FROM capped c JOIN exits x USING (symbol)")
def decisions(spark, sf):
    run = Rules(spark, sf)
    return six(K.decisions(K.entry_cap(run.entries, n=5), run.exits), "score")


@query("SELECT symbol, seq, position_qty, round(avg_entry_price, 6) AS avg_entry_price, round(realized_pnl, 6) AS realized_pnl, round(cash_delta, 6) AS cash_delta FROM replay")
def position_replay(spark, sf):
    rows = Rules(spark, sf).replay.select("symbol", "seq", "position_qty", "avg_entry_price", "realized_pnl", "cash_delta")
    return six(rows, "avg_entry_price", "realized_pnl", "cash_delta")


@query("""SELECT symbol, seq, unnest([x FOR x IN [CASE WHEN q < -1e-12 THEN 'oversell' END, CASE WHEN qty <= 0 THEN 'quantity' END, CASE WHEN price <= 0 THEN 'price' END, CASE WHEN fee < 0 THEN 'fee' END, CASE WHEN cash < 0 THEN 'negative_cash' END] IF x IS NOT NULL]) AS violation
  FROM (SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER w AS q, 50000 + sum(CASE WHEN side = 'buy' THEN -(qty * price + fee) ELSE qty * price - fee END) OVER w AS cash FROM badfills WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING))""")
def fill_violations(spark, sf):
    rows = X.fills(spark, sf).selectExpr(
        "symbol", "seq", "side", "case when seq % 97 = 0 then -qty when seq % 31 = 0 then qty * 500 else qty end as qty", "if(seq % 89 = 0, 0D, price) as price", "if(seq % 83 = 0, -fee - 1, fee) as fee"
    )
    return L.fill_violations(rows, cash=50_000.0)


@query("SELECT symbol, count(*) AS fills, round(sum(fee), 6) AS fees, round(sum(realized_pnl), 6) AS realized_pnl, round(sum(cash_delta), 6) AS cash_delta, round(sum(qty * price), 6) AS notional FROM replay GROUP BY 1")
def ledger_totals(spark, sf):
    return six(L.totals(Rules(spark, sf).replay), "fees", "realized_pnl", "cash_delta", "notional")


VIEWS |= {
    "tfills": "SELECT symbol, seq, side, CASE WHEN side = 'sell' AND seq % 6 = 0 THEN greatest(prevq, 0) ELSE qty END AS qty, filled_ms FROM (SELECT *, lag(position_qty) OVER (PARTITION BY symbol ORDER BY seq) AS prevq FROM fq)",
    "tisl": """SELECT *, sum(flat) OVER w - flat AS island FROM (SELECT *, (abs(sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)) <= 1e-12)::INT AS flat FROM tfills) WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    "tper": "SELECT symbol, island, arg_min(filled_ms, seq) FILTER (side = 'buy') AS entry_ms, max(flat) AS closed, arg_max(filled_ms, seq) AS end_ms FROM tisl GROUP BY 1, 2",
}


@query("SELECT symbol, CASE WHEN arg_max(closed, island) = 0 THEN arg_max(entry_ms, island) END AS entry_ms, arg_max(end_ms, island) FILTER (closed = 1) AS last_exit_ms FROM tper GROUP BY 1")
def position_times(spark, sf):
    """Every third sale closes the position, as far as the running quantity of the plain log says."""
    from pyspark.sql import Window

    fills = X.fills(spark, sf)
    w = Window.partitionBy("symbol").orderBy("seq")
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    rows = fills.withColumn("q", F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prevq", F.lag("q").over(w))
    all_out = F.when((F.col("side") == "sell") & (F.col("seq") % 6 == 0), F.greatest("prevq", F.lit(0.0))).otherwise(F.col("qty"))
    return L.position_times(rows.select("symbol", "seq", "side", all_out.alias("qty"), "filled_ms"))


@query("SELECT symbol, seq, round(CASE WHEN ref > 0 AND price > 0 THEN greatest(0, CASE WHEN side = 'buy' THEN price / ref - 1 ELSE 1 - price / ref END) ELSE 0 END, 6) AS slippage, CASE WHEN ref > 0 AND price > 0 THEN greatest(0, CASE WHEN side = 'buy' THEN price / ref - 1 ELSE 1 - price / ref END) ELSE 0 END > 0.02::DOUBLE AS breach FROM (SELECT *, price + seq % 7 - 3 AS ref FROM fills)")
def slippage(spark, sf):
    rows = X.fills(spark, sf)
    made = rows.select("symbol", "seq", L.slippage(F.col("side"), F.col("price") + F.col("seq") % 7 - 3, F.col("price")).alias("slippage"))
    return six(made.withColumn("breach", L.slippage_breach(F.col("slippage"), 0.02)), "slippage")


VIEWS |= {
    "rbal": "SELECT 'S' || (c_custkey % 4) || '-' || (c_custkey % 130) AS symbol, round(abs(c_acctbal), 2) AS amount, c_custkey % 3 AS hold FROM customer",
    "rpos": "SELECT symbol, qty, avg_entry_price, 100::DOUBLE AS reference_price FROM pos",
}


@query(f"""SELECT symbol, old AS old_qty, round(new, 6) AS new_qty, action, round(CASE WHEN new = 0 THEN 0 WHEN old = 0 OR coalesce(avg_entry_price, 0) <= 0 THEN reference_price ELSE avg_entry_price END, 6) AS avg_entry_price, CASE WHEN action = 'closed' THEN {NOW} END AS exit_ms FROM (
  SELECT *, CASE WHEN abs(new - old) <= 1e-9 THEN 'unchanged' WHEN new = 0 THEN 'closed' WHEN old = 0 THEN 'opened' ELSE 'adjusted' END AS action FROM (SELECT symbol, coalesce(qty, 0) AS old, greatest(0, coalesce(available, 0)) AS new, avg_entry_price, reference_price
  FROM rpos FULL JOIN (SELECT symbol, sum(amount - hold) AS available FROM rbal GROUP BY 1) USING (symbol)))""")
def reconcile(spark, sf):
    run = Rules(spark, sf)
    balances = A.read_table(spark, sf, "customer").selectExpr("concat('S', c_custkey % 4, '-', c_custkey % 130) as symbol", "round(abs(c_acctbal), 2) as amount", "c_custkey % 3 as hold")
    positions = run.positions.select("symbol", "qty", "avg_entry_price", F.lit(100.0).alias("reference_price"))
    return six(L.reconcile(positions, balances, now_ms=NOW), "new_qty", "avg_entry_price")


@query("""SELECT account, round(cash, 6) AS old_cash, round(CASE WHEN cash <= a + 1e-9 THEN cash ELSE greatest(0, a) END, 6) AS new_cash, cash > a + 1e-9 AS capped
  FROM (SELECT c_nationkey AS account, cash, coalesce(a, 0) AS a FROM (SELECT c_nationkey, sum(abs(c_acctbal)) / 12 AS cash FROM customer GROUP BY 1) LEFT JOIN (SELECT s_nationkey AS c_nationkey, sum(s_acctbal - s_suppkey % 3) AS a FROM supplier GROUP BY 1) USING (c_nationkey))""")
def cash_cap(spark, sf):
    books = A.read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("account")).agg((F.sum(F.abs("c_acctbal")) / 12).alias("cash"))
    balances = A.read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("account"), F.col("s_acctbal").alias("amount"), (F.col("s_suppkey") % 3).alias("hold"))
    return six(L.cap_books(books, balances), "old_cash", "new_cash")


@query("SELECT day, round(p, 6) AS realized_pnl, round(p, 6) <= -50 AS breach FROM (SELECT strftime(epoch_ms(filled_ms), '%Y-%m-%d') AS day, sum(realized_pnl) AS p FROM replay GROUP BY 1)")
def daily_pnl(spark, sf):
    return six(L.daily_pnl(Rules(spark, sf).replay, cap=50.0), "realized_pnl")


@query("""SELECT runner, day, seq, c AS consecutive_errors, CASE WHEN c >= 5 THEN 'halt' WHEN c >= 2 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE errors END) OVER (PARTITION BY runner, day, island ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS c
  FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY runner, day ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM cycles))""")
def error_streaks(spark, sf):
    return L.error_streaks(X.cycles(spark, sf), limit=5)


@query("SELECT row_key, timestamp_ms, round(CASE WHEN s >= 300 THEN s ELSE 0 END, 6) AS notional FROM (SELECT *, 1000 / (count(*) OVER (PARTITION BY timestamp_ms) * (1 + 0.002::DOUBLE)) AS s FROM preds WHERE probability >= 0.9)")
def entry_sizing(spark, sf):
    rows = X.preds(spark, sf).where("probability >= 0.9").select("row_key", "timestamp_ms")
    return six(L.entry_sizing(rows, spendable=1000.0, fee=0.002, minimum=300.0), "notional")


VIEWS |= {
    "ord": "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_orderkey % 9 + 0.5::DOUBLE AS ordered_qty, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 100::DOUBLE + o_orderkey % 10 END AS limit_price, 5::DOUBLE AS position_qty FROM orders",
    "sts": "SELECT l_orderkey AS order_id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS seq, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_quantity / 4 END AS executed_qty, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 100::DOUBLE + l_partkey % 20 END AS avg_price, ['filled', 'working', 'rejected', 'canceled'][l_partkey % 4 + 1] AS state FROM lineitem",
    "norm": """SELECT order_id, side, CASE WHEN q > 0 AND p IS NOT NULL THEN 'fill' WHEN state IS NULL THEN 'no_match' WHEN state IN ('rejected', 'canceled', 'expired', 'filled') THEN 'rejected' ELSE 'open' END AS outcome, q, p FROM (
      SELECT o.*, state, CASE WHEN side = 'sell' THEN least(q0, position_qty) ELSE q0 END AS q, coalesce(CASE WHEN avg_price > 0 THEN avg_price END, CASE WHEN limit_price > 0 THEN limit_price END) AS p FROM (
      SELECT o.*, state, avg_price, CASE WHEN executed_qty > 0 THEN executed_qty WHEN state = 'filled' AND ordered_qty > 0 THEN ordered_qty END AS q0 FROM ord o LEFT JOIN (SELECT order_id, max_by(struct_pack(executed_qty, avg_price, state), (seq, executed_qty, state)) AS s FROM sts GROUP BY 1) USING (order_id), LATERAL (SELECT s.executed_qty, s.avg_price, s.state)) o)""",
}


@query("SELECT order_id, side, outcome, CASE WHEN outcome = 'fill' THEN q END AS qty, CASE WHEN outcome = 'fill' THEN p END AS price, round(CASE WHEN outcome = 'fill' THEN q * p * 0.002::DOUBLE END, 6) AS fee FROM norm")
def fill_normalize(spark, sf):
    orders = A.read_table(spark, sf, "orders").selectExpr(
        "o_orderkey as order_id", "if(o_orderkey % 2 = 0, 'buy', 'sell') as side", "o_orderkey % 9 + 0.5D as ordered_qty", "if(o_orderkey % 6 = 0, null, 100D + o_orderkey % 10) as limit_price", "5D as position_qty"
    )
    statuses = A.read_table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as order_id", "struct(l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 as a, if(l_partkey % 4 = 0, 0D, l_quantity / 4) as b, element_at(array('filled', 'working', 'rejected', 'canceled'), cast(l_partkey % 4 + 1 as int)) as c) as seq",
        "if(l_partkey % 4 = 0, 0D, l_quantity / 4) as executed_qty", "if(l_suppkey % 5 = 0, 0D, 100D + l_partkey % 20) as avg_price", "element_at(array('filled', 'working', 'rejected', 'canceled'), cast(l_partkey % 4 + 1 as int)) as state",
    )
    return six(L.fill_normalize(orders, statuses, fee_rate=0.002), "fee")


for _name, _f in list(QUERIES.items()):
    if _f.__module__ == __name__ and _name in ORACLES:
        ORACLES[_name] = ORACLES[_name].replace(", 6)", " + 1e-9, 6)")
