"""Rolling features and exponential means of daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as G
from ..operators import normalize as N
from ..sources import fixtures as X
from ..sources.staging import staged
from . import VIEWS, query

P = "PARTITION BY symbol ORDER BY timestamp_ms"


def fr(n: int) -> str:
    return f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {fr(n)} = {n} THEN {agg} OVER {fr(n)} END"


def ret(x: str, n: int) -> str:
    return f"{x} / nullif(lag({x}, {n}) OVER ({P}), 0) - 1"


VIEWS |= {
    "franked": """SELECT symbol, timestamp_ms, close * CASE venue WHEN 'native' THEN 1 WHEN 'ext_a' THEN 2 ELSE 4 END AS close, volume,
      CASE WHEN venue = 'native' THEN 'native' WHEN source LIKE '%_fill' THEN 'synthetic_fill' ELSE 'synthetic' END AS source, row_number() OVER (PARTITION BY symbol, timestamp_ms ORDER BY CASE venue WHEN 'native' THEN 0 WHEN 'ext_a' THEN 1 ELSE 2 END) AS rk FROM vbars""",
    "fplain": "SELECT symbol, timestamp_ms, close, volume, source FROM franked WHERE rk = 1",
    "fjoined": """SELECT f.*, e.close AS ext_close, n.close AS native_close, CASE WHEN f.symbol IN ('S0', 'S1') THEN 1 ELSE fx.rate END AS fx_rate FROM fplain f LEFT JOIN fx ON fx.timestamp_ms = f.timestamp_ms LEFT JOIN (SELECT * FROM vbars WHERE venue = 'ext_a') e ON e.symbol = f.symbol AND e.timestamp_ms = f.timestamp_ms
      LEFT JOIN (SELECT * FROM vbars WHERE venue = 'native') n ON n.symbol = f.symbol AND n.timestamp_ms = f.timestamp_ms""",
    "fb": f"""SELECT *, {ret('close', 1)} AS r, close - lag(close) OVER ({P}) AS d, {ret('ext_close', 1)} AS er, CASE WHEN native_close > 0 AND ext_close > 0 AND fx_rate > 0 THEN native_close / (ext_close * fx_rate) END AS b FROM fjoined""",
}
SQLS = {
    "returns": {f"combined_ret_{n}": ret("close", n) for n in G.RETURNS},
    "trend": {f"combined_trend_{n}": full("avg(r)", "r", n) for n in G.WINDOWS},
    "vol": {f"combined_vol_{n}": full("stddev_pop(r)", "r", n) for n in G.WINDOWS},
    "volume": {f"volume_ratio_{n}": f"volume / nullif({full('avg(volume)', 'volume', n)}, 0)" for n in G.WINDOWS},
    "rsi": {
        f"rsi_{n}": f"CASE WHEN count(d) OVER {fr(n)} = {n} THEN 100 - 100 / (1 + (avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) OVER {fr(n)}) / nullif(avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) OVER {fr(n)}, 0)) END"
        for n in G.RSI
    },
    "zscore": {f"dist_mean_{n}": f"close / nullif({full('avg(close)', 'close', n)}, 0) - 1" for n in G.WINDOWS[1:]}
    | {f"zscore_{n}": f"(close - {full('avg(close)', 'close', n)}) / nullif({full('stddev_pop(close)', 'close', n)}, 0)" for n in G.WINDOWS[1:]},
    "source": {"is_native": "(source = 'native')::DOUBLE", "is_synthetic": "(source = 'synthetic')::DOUBLE", "is_synthetic_gap_fill": "(source = 'synthetic_fill')::DOUBLE"}
    | {f"synthetic_share_{n}": f"avg((source <> 'native')::DOUBLE) OVER {fr(n)}" for n in G.WINDOWS[1:]}
    | {f"gap_fill_count_{n}": f"sum((source = 'synthetic_fill')::DOUBLE) OVER {fr(n)}" for n in G.WINDOWS[1:]},
    "external": {f"external_ret_{n}": ret("ext_close", n) for n in (1, 4, 16)} | {"external_absret_1": "abs(er)"} | {f"external_vol_{n}": full("stddev_pop(er)", "er", n) for n in (4, 16)},
    "native": {f"native_ret_{n}": ret("native_close", n) for n in (1, 4, 16)} | {f"native_present_{n}": f"avg((native_close IS NOT NULL)::DOUBLE) OVER {fr(n)}" for n in (1, 4, 16)},
    "basis": {"basis_level": "b", "basis_zscore_96": f"(b - {full('avg(b)', 'b', 96)}) / nullif({full('stddev_pop(b)', 'b', 96)}, 0)", "external_ctx_available": "(ext_close IS NOT NULL)::DOUBLE",
              "native_ctx_available": "(native_close IS NOT NULL)::DOUBLE", "basis_available": "(b IS NOT NULL)::DOUBLE"},
}


def select(group: str) -> str:
    return "SELECT symbol, timestamp_ms, " + ", ".join(f"round({e}, 5) AS {n}" for n, e in SQLS[group].items()) + " FROM fb"


def bars(spark, sf) -> DataFrame:
    scale = F.expr("case venue when 'native' then 1 when 'ext_a' then 2 else 4 end")
    rank = F.expr("case venue when 'native' then 0 when 'ext_a' then 1 else 2 end")
    tag = F.expr("case when venue = 'native' then 'native' when source like '%_fill' then 'synthetic_fill' else 'synthetic' end")
    row = F.struct((F.col("close") * scale).alias("close"), "volume", tag.alias("source"))
    return X.vbars(spark, sf).groupBy("symbol", "timestamp_ms").agg(F.min_by(row, rank).alias("x")).select("symbol", "timestamp_ms", "x.*")


def rates(spark, sf, rows: DataFrame) -> DataFrame:
    """Two symbols are quoted in the account's currency, whose rate is 1; the others take the rate of exactly that time."""
    quoted = rows.select("symbol", "timestamp_ms", F.when(F.col("symbol").isin("S0", "S1"), "CAD").otherwise("USD").alias("quote_currency"))
    return N.exact_rate(quoted, X.fx(spark, sf)).select("symbol", "timestamp_ms", F.col("rate").alias("close"))


def base(spark, sf) -> DataFrame:
    v = X.vbars(spark, sf)
    rows = G.context_columns(G.context_columns(bars(spark, sf), v.where("venue = 'ext_a'"), "ext_close"), v.where("venue = 'native'"), "native_close")
    rows = G.context_columns(rows, rates(spark, sf, rows), "fx_rate")
    return G.with_base(rows).withColumns({"_er": G.n_bar_return("ext_close", 1), "_basis": G.basis_level(F.col("fx_rate"))})


def register(group: str, columns) -> None:
    def run(spark, sf) -> DataFrame:
        made = columns()
        return base(spark, sf).withColumns(made).select("symbol", "timestamp_ms", *(F.round(F.col(n), 5).alias(n) for n in made))

    query(select(group), name=f"feat_{group}")(run)


for _group, _columns in (
    ("returns", G.returns), ("trend", G.trend), ("vol", G.volatility), ("volume", G.volume), ("rsi", G.rsi), ("zscore", G.distance),
    ("source", G.source_flags), ("external", G.external), ("native", G.native), ("basis", G.basis),
):
    register(_group, _columns)

VIEWS |= {
    "fnum": f"SELECT symbol, timestamp_ms, close, row_number() OVER ({P}) AS n FROM fplain",
    "femas": "SELECT symbol, n, timestamp_ms, "
    + ", ".join(f"close AS e{s}" for s in (8, 16, 32, 64, 128))
    + " FROM fnum WHERE n = 1 UNION ALL SELECT f.symbol, f.n, f.timestamp_ms, "
    + ", ".join(f"(1 - 2::DOUBLE / {s + 1}) * e.e{s} + 2::DOUBLE / {s + 1} * f.close" for s in (8, 16, 32, 64, 128))
    + " FROM femas e JOIN fnum f ON f.symbol = e.symbol AND f.n = e.n + 1",
}


@query("SELECT symbol, timestamp_ms, " + ", ".join(f"round(CASE WHEN n >= {b} THEN e{a} / nullif(e{b}, 0) - 1 END, 8) AS ema_ratio_{a}_{b}" for a, b in G.EMA_PAIRS) + " FROM femas")
def feat_ema(spark, sf):
    names = [f"ema_ratio_{a}_{b}" for a, b in G.EMA_PAIRS]
    return G.ema_ratios(bars(spark, sf)).select("symbol", "timestamp_ms", *(F.round(n, 8).alias(n) for n in names))


VIEWS |= {
    "sjoined": """SELECT s.symbol, s.timestamp_ms, s.close, s.volume, s.source, s.row_status, s.y, s.forward_return, s.effective_monthly_weight, s.supervised_row_weight, e.close AS ext_close, n.close AS native_close,
      CASE WHEN s.symbol IN ('S0', 'S1') THEN 1 ELSE fx.rate END AS fx_rate FROM snap s LEFT JOIN fx ON fx.timestamp_ms = s.timestamp_ms LEFT JOIN (SELECT * FROM vbars WHERE venue = 'ext_a') e ON e.symbol = s.symbol AND e.timestamp_ms = s.timestamp_ms
      LEFT JOIN (SELECT * FROM vbars WHERE venue = 'native') n ON n.symbol = s.symbol AND n.timestamp_ms = s.timestamp_ms""",
    "sfb": f"""SELECT *, {ret('close', 1)} AS r, close - lag(close) OVER ({P}) AS d, {ret('ext_close', 1)} AS er, CASE WHEN native_close > 0 AND ext_close > 0 AND fx_rate > 0 THEN native_close / (ext_close * fx_rate) END AS b,
      row_number() OVER ({P}) AS n FROM sjoined""",
    "semas": "SELECT symbol, n, "
    + ", ".join(f"close AS e{s}" for s in (8, 16, 32, 64, 128))
    + " FROM sfb WHERE n = 1 UNION ALL SELECT f.symbol, f.n, "
    + ", ".join(f"(1 - 2::DOUBLE / {s + 1}) * e.e{s} + 2::DOUBLE / {s + 1} * f.close" for s in (8, 16, 32, 64, 128))
    + " FROM semas e JOIN sfb f ON f.symbol = e.symbol AND f.n = e.n + 1",
}
ALL = {n: e for g in SQLS.values() for n, e in g.items()}


@query("SELECT symbol, timestamp_ms, source, " + ", ".join(f"round((coalesce({e}, 0))::REAL::DOUBLE, 4) AS {n}" for n, e in ALL.items()) + " FROM fb")
def feature_table(spark, sf):
    v = staged(X.vbars(spark, sf))
    rows = bars(spark, sf).withColumn("row_status", F.lit("trainable"))
    made = G.feature_table(rows, v.where("venue = 'ext_a'"), v.where("venue = 'native'"), rates(spark, sf, rows), with_ema=False)
    return made.select("symbol", "timestamp_ms", "source", *(F.round(F.col(n).cast("double"), 4).alias(n) for n in ALL))


EMAS = {f"ema_ratio_{a}_{b}": f"CASE WHEN n >= {b} THEN e{a} / nullif(e{b}, 0) - 1 END" for a, b in G.EMA_PAIRS}
OWN = {new: old for old, new in G.WEIGHT_FEATURES.items()}
WHOLE = [*ALL, *OWN, *EMAS]


def snapshot_table(spark, sf) -> DataFrame:
    """All features of the fused snapshot's trainable rows, with their labels and the weight that fits use."""
    from .snapshots import Snapshot

    v = staged(X.vbars(spark, sf))
    rows = staged(Snapshot(spark, sf).rows)
    return G.feature_table(rows, v.where("venue = 'ext_a'"), v.where("venue = 'native'"), rates(spark, sf, rows))


@query(
    "SELECT symbol, timestamp_ms, "
    + ", ".join(f"round((coalesce({n}, 0))::REAL::DOUBLE, 4) AS {n}" for n in WHOLE)
    + " FROM (SELECT symbol, timestamp_ms, row_status, " + ", ".join(f"{e} AS {n}" for n, e in (ALL | OWN).items()) + " FROM sfb) JOIN (SELECT symbol, n, " + ", ".join(f"{e} AS {n}" for n, e in EMAS.items())
    + " FROM semas) USING (symbol) JOIN (SELECT symbol, n AS m, timestamp_ms FROM sfb) USING (symbol, timestamp_ms) WHERE n = m AND row_status = 'trainable'"
)
def snapshot_features(spark, sf):
    made = snapshot_table(spark, sf)
    return made.select("symbol", "timestamp_ms", *(F.round(F.col(n).cast("double"), 4).alias(n) for n in WHOLE))
