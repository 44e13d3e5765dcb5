"""Ordered work over keys of any size. No window holds a whole key: rows lie in cells, cells in coarser cells, and what comes before
a row is put together level by level.

* ``prefix_sums``: sums of all rows before each one.
* ``order_statistics``: values at given ranks, exactly.
* ``scan``: for each chunk of a key the composition of the maps of all chunks before it, for any associative map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(rows: DataFrame, keys: list[str], cells: list[Column], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` plus, for each name of ``sums``, its sum over the rows of the key that come before this one (0 for the first).

    ``cells`` are from coarse to fine and never fall along ``order``. A window holds the cells within the next coarser one, or the
    rows of a finest cell. Keys and cells must not be null.
    """
    levels, parts = [f"_cell{i}" for i in range(len(cells))], [f"_sum{i}" for i in range(len(sums))]
    wide = rows.withColumns(dict(zip(levels, cells, strict=True)) | dict(zip(parts, sums.values(), strict=True)))
    tables, table = [], wide
    for k in range(len(levels), 0, -1):
        table = table.groupBy(*keys, *levels[:k]).agg(*(F.sum(p).alias(p) for p in parts))
        tables.append(table)
    base = None
    for k, table in enumerate(reversed(tables)):
        w = Window.partitionBy(*keys, *levels[:k]).orderBy(levels[k]).rowsBetween(*BEFORE)
        here = table.select(*keys, *levels[: k + 1], *(F.coalesce(F.sum(p).over(w), F.lit(0)).alias(f"{p}b") for p in parts))
        if base is not None:
            here = here.join(base, [*keys, *levels[:k]]).select(*keys, *levels[: k + 1], *((F.col(f"{p}b") + F.col(f"{p}c")).alias(f"{p}b") for p in parts))
        base = here.select(*keys, *levels[: k + 1], *(F.col(f"{p}b").alias(f"{p}c") for p in parts))
    w = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(*BEFORE)
    inner = wide.withColumns({f"{p}i": F.coalesce(F.sum(p).over(w), F.lit(0)) for p in parts}).join(base, [*keys, *levels])
    return inner.select(*rows.columns, *((F.col(f"{p}c") + F.col(f"{p}i")).alias(n) for p, n in zip(parts, sums, strict=True)))


def value_cells(value: str) -> list[Column]:
    """Two cells of a double, each a function that never falls: steps of 0.4 % and of a millionth of the value's size, apart by sign."""
    v = F.col(value).cast("double")
    offset = 1 << 40

    def cell(steps: int) -> Column:
        size = F.floor(F.log(F.abs(v)) * steps).cast("bigint")  # the logarithm never falls
        low = F.ceil(F.log(F.abs(v)) * steps).cast("bigint")
        finite = F.when(v > 0, size + offset).when(v < 0, -low - offset).otherwise(F.lit(0).cast("bigint"))
        top = F.isnan(v) | (v == float("inf"))
        return F.when(top, F.lit(1 << 60)).when(v == float("-inf"), F.lit(-(1 << 60))).otherwise(finite)

    return [cell(256), cell(1 << 20)]


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """``(*keys, n, which, value)``: of each key's non-null values, ordered, those at ``ranks(n)`` (from 0), one row for each rank.

    Values are counted once, spread by value; counts per cell locate each rank in a coarse cell, then in a fine one of it, then
    among the distinct values there. Rows never meet by key alone.
    """
    levels = ["_cell0", "_cell1", value]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).withColumns(dict(zip(levels[:2], value_cells(value), strict=True)))
    tables = [counted]
    for k in (2, 1):
        tables.append(tables[-1].groupBy(*keys, *levels[:k]).agg(F.sum("_c").alias("_c")))
    total = tables[-1].groupBy(*keys).agg(F.sum("_c").alias("n"))
    wanted = F.array(*(r.cast("bigint") for r in ranks(F.col("n"))))
    sought = total.select(*keys, "n", F.posexplode(wanted).alias("which", "_rank"))
    for k, table in enumerate(reversed(tables)):
        w = Window.partitionBy(*keys, "which", *levels[:k]).orderBy(levels[k]).rowsBetween(*BEFORE)
        placed = table.join(sought, [*keys, *levels[:k]]).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        here = placed.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        sought = here.select(*keys, "n", "which", *levels[: k + 1], (F.col("_rank") - F.col("_before")).alias("_rank"))
    return sought.select(*keys, "n", "which", value)


def scan(chunks: DataFrame, keys: list[str], levels: list[str], value: str, identity: Column, compose: Callable[[Column, Column], Column]) -> DataFrame:
    """``(*keys, *levels, _carry)``: for each chunk the maps of all earlier chunks of its key, composed in order.

    ``levels`` number the chunks from coarse to fine (bigint). Chunks are folded within each cell of the level above, the cells'
    maps within theirs, and so on; the carries then come down the same way. ``compose(first, then)`` must be associative.
    """
    kind = chunks.schema[value].dataType.simpleString()
    table, folds = chunks.select(*keys, *levels, F.col(value).alias("_m")), []
    for k in range(len(levels) - 1, -1, -1):
        by = [*keys, *levels[:k]]
        start = F.struct(identity.alias("m"), F.array().cast(f"array<struct<_at:bigint,_m:{kind}>>").alias("out"))
        step = lambda s, x: F.struct(compose(s["m"], x["_m"]).alias("m"), F.array_append(s["out"], F.struct(x["_at"].alias("_at"), s["m"].alias("_m"))).alias("out"))
        listed = F.array_sort(F.collect_list(F.struct(F.col(levels[k]).alias("_at"), "_m")), lambda x, y: F.when(x["_at"] < y["_at"], -1).when(x["_at"] > y["_at"], 1).otherwise(0))
        fold = table.groupBy(*by).agg(listed.alias("_x")).select(*by, F.aggregate("_x", start, step).alias("_f"))
        folds.append(fold)
        table = fold.select(*by, F.col("_f.m").alias("_m"))
    carry = None
    for k, fold in enumerate(reversed(folds)):
        here = fold.select(*keys, *levels[:k], F.explode("_f.out").alias("_o")).select(*keys, *levels[:k], F.col("_o._at").alias(levels[k]), F.col("_o._m").alias("_carry"))
        if carry is not None:
            above = carry.withColumnRenamed("_carry", "_above")
            here = here.join(above, [*keys, *levels[:k]]).select(*keys, *levels[: k + 1], compose(F.col("_above"), F.col("_carry")).alias("_carry"))
        carry = here
    return carry
