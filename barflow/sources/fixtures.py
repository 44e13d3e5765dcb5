"""Market-shaped views of the driver's tables, derived by integer rules; each has DuckDB SQL of the same rows in ``SQL``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

DAY, HOUR = 86_400_000, 3_600_000
TICKS_FROM, TICKS_TO = 1_704_067_200_000, 1_706_659_200_000  # 2024-01-01 .. 2024-01-31, exclusive
INPUT_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_type as symbol",
        "unix_millis(cast(ts as timestamp)) as ts_ms",
        "value as price",
        "cast(get_json_object(props, '$.k') as double) as volume",
        "event_id as seq",
    ).where("price > 0")


def vbars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of three venues; some cells are missing, some rows of other venues are gap fills."""
    rows = read_table(spark, sf_dir, "lineitem").selectExpr(
        "unix_millis(cast(l_shipdate as timestamp)) div 86400000 as dayno",
        "l_suppkey % 4 as sym",
        "case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end as v",
        "l_orderkey * 31 + l_linenumber as k",
        "l_quantity as q",
    )
    cells = rows.where("(dayno * 7 + sym * 3 + v * 5) % 11 <> 0").groupBy("dayno", "sym", "v").agg(F.max("k").alias("k"), F.sum("q").alias("q"))
    priced = cells.selectExpr(
        "dayno", "sym", "v", "q",
        "(100 + (7 * dayno % 31) * 0.5D) / case v when 0 then 1D when 1 then 2D else 4D end as open",
        "1 + (k % 200 - 100) / 10000D as move",
        "v > 0 and dayno % 13 = 0 as fill",
    )
    return priced.selectExpr(
        "case v when 0 then 'native' when 1 then 'ext_a' else 'ext_b' end as venue",
        "concat('S', sym) as symbol",
        "dayno * 86400000 as timestamp_ms",
        "open",
        "greatest(open, open * move) * 1.01D as high",
        "least(open, open * move) * 0.99D as low",
        "open * move as close",
        "if(fill, 0D, q) as volume",
        "concat(case v when 0 then 'native' when 1 then 'ext_a' else 'ext_b' end, if(fill, '_fill', '')) as source",
    )


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read_table(spark, sf_dir, "orders").selectExpr("unix_millis(cast(o_orderdate as timestamp)) div 86400000 as dayno").distinct()
    return days.where("dayno % 2 = 0").selectExpr("dayno * 86400000 as timestamp_ms", "2 + (dayno % 10) / 100D as rate")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").selectExpr(
        "cast((year(l_shipdate) * 12 + month(l_shipdate)) % 12 + 1 as int) as fold",
        "if(l_linestatus = 'O', 'weighted', 'native_only') as scenario",
        "if(l_partkey % 2 = 0, 'global', 'symbol') as scope",
        "concat('S', l_suppkey % 4) as symbol",
        "unix_millis(cast(l_shipdate as timestamp)) as timestamp_ms",
        "case l_returnflag when 'N' then 'native' when 'A' then 'synthetic' else 'synthetic_fill' end as source",
        "cast((l_orderkey + l_linenumber) % 3 = 0 as int) as y",
        "((13 * l_orderkey + 7 * l_partkey) % 2001 - 1000) / 50000D as forward_return",
        "((37 * l_partkey + 11 * l_linenumber) % 1000) / 1000D as probability",
        "concat_ws('-', lpad(l_orderkey, 12, '0'), l_linenumber, lpad(l_partkey, 12, '0'), lpad(l_suppkey, 8, '0'), lpad(cast(l_quantity as bigint), 6, '0')) as row_key",
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades per symbol in input order: odd ones buy, even ones sell half of the purchase before (so never too much)."""
    from pyspark.sql import Window

    rows = read_table(spark, sf_dir, "lineitem").select(*INPUT_ORDER, "l_shipdate", F.expr("concat('A', l_suppkey % 16, 'M', l_partkey % 32)").alias("symbol"))
    w = Window.partitionBy("symbol").orderBy(*INPUT_ORDER)
    numbered = rows.withColumns({"seq": F.row_number().over(w), "prev": F.lag("l_quantity").over(w)})
    return numbered.selectExpr(
        "symbol", "cast(seq as bigint) as seq", "if(seq % 2 = 1, 'buy', 'sell') as side", "if(seq % 2 = 1, l_quantity, prev / 2) as qty",
        "100D + (l_partkey % 50) as price", "(l_orderkey % 5) / 10D as fee", "unix_millis(cast(l_shipdate as timestamp)) as filled_ms",
    )


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", "unix_millis(cast(ts as timestamp)) as ts_ms", "date_format(ts, 'yyyy-MM-dd') as day", "event_type <> 'error' and event_id % 7 <> 0 as ok",
        "concat('u', user_id % 64) as runner", "cast(1 + event_id % 2 as int) as errors",
    )


SQL = {
    "ticks": "SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts_ms, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS seq FROM events WHERE value > 0",
    "vcells": """SELECT dayno, sym, v, max(k) AS k, sum(q) AS q FROM (SELECT epoch_ms(l_shipdate) // 86400000 AS dayno, l_suppkey % 4 AS sym,
      CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS v, l_orderkey * 31 + l_linenumber AS k, l_quantity AS q FROM lineitem)
      WHERE (dayno * 7 + sym * 3 + v * 5) % 11 <> 0 GROUP BY ALL""",
    "vpriced": """SELECT dayno, sym, v, q, (100 + (7 * dayno % 31) * 0.5::DOUBLE) / CASE v WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 4::DOUBLE END AS open,
      1 + (k % 200 - 100) / 10000::DOUBLE AS move, v > 0 AND dayno % 13 = 0 AS fill FROM vcells""",
    "vbars": """SELECT CASE v WHEN 0 THEN 'native' WHEN 1 THEN 'ext_a' ELSE 'ext_b' END AS venue, 'S' || sym AS symbol, dayno * 86400000 AS timestamp_ms, open,
      greatest(open, open * move) * 1.01::DOUBLE AS high, least(open, open * move) * 0.99::DOUBLE AS low, open * move AS close, CASE WHEN fill THEN 0 ELSE q END AS volume,
      CASE v WHEN 0 THEN 'native' WHEN 1 THEN 'ext_a' ELSE 'ext_b' END || CASE WHEN fill THEN '_fill' ELSE '' END AS source FROM vpriced""",
    "fx": """SELECT dayno * 86400000 AS timestamp_ms, 2 + (dayno % 10) / 100::DOUBLE AS rate
      FROM (SELECT DISTINCT epoch_ms(o_orderdate) // 86400000 AS dayno FROM orders) WHERE dayno % 2 = 0""",
    "preds": """SELECT ((year(l_shipdate) * 12 + month(l_shipdate)) % 12 + 1)::INT AS fold, CASE WHEN l_linestatus = 'O' THEN 'weighted' ELSE 'native_only' END AS scenario,
      CASE WHEN l_partkey % 2 = 0 THEN 'global' ELSE 'symbol' END AS scope, 'S' || (l_suppkey % 4) AS symbol, epoch_ms(l_shipdate) AS timestamp_ms,
      CASE l_returnflag WHEN 'N' THEN 'native' WHEN 'A' THEN 'synthetic' ELSE 'synthetic_fill' END AS source, ((l_orderkey + l_linenumber) % 3 = 0)::INT AS y,
      ((13 * l_orderkey + 7 * l_partkey) % 2001 - 1000) / 50000::DOUBLE AS forward_return, ((37 * l_partkey + 11 * l_linenumber) % 1000) / 1000::DOUBLE AS probability,
      concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, lpad(l_partkey::VARCHAR, 12, '0'), lpad(l_suppkey::VARCHAR, 8, '0'), lpad(l_quantity::BIGINT::VARCHAR, 6, '0')) AS row_key
      FROM lineitem""",
    "fills": """SELECT symbol, seq, CASE WHEN seq % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN seq % 2 = 1 THEN l_quantity ELSE prev / 2 END AS qty,
      100::DOUBLE + (l_partkey % 50) AS price, (l_orderkey % 5) / 10::DOUBLE AS fee, epoch_ms(l_shipdate) AS filled_ms
      FROM (SELECT *, row_number() OVER w AS seq, lag(l_quantity) OVER w AS prev FROM (SELECT *, 'A' || (l_suppkey % 16) || 'M' || (l_partkey % 32) AS symbol FROM lineitem)
      WINDOW w AS (PARTITION BY symbol ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity))""",
    "cycles": """SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, strftime(ts, '%Y-%m-%d') AS day, event_type <> 'error' AND event_id % 7 <> 0 AS ok,
      'u' || (user_id % 64) AS runner, (1 + event_id % 2)::INT AS errors FROM events""",
}


def with_views(body: str, more: dict[str, str] | None = None) -> str:
    """``body`` with a WITH clause of the views that it names, directly or by other views."""
    views = SQL | (more or {})
    wanted: list[str] = []
    begun: set[str] = set()  # a recursive view names itself

    def visit(text: str) -> None:
        for name in views:
            if name not in begun and re.search(rf"\b{name}\b", text):
                begun.add(name)
                visit(views[name])
                wanted.append(name)

    visit(body)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    head = ", ".join(f"{n} AS ({views[n]})" for n in wanted)
    if not wanted:
        return body
    return f"WITH RECURSIVE {head}" + (f", {body[own.end():]}" if own else f" {body}")
