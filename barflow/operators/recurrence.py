"""Linear recurrences y[t] = a[t] * y[t-1] + b[t] per key, in parallel within a key, several at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.staging import staged
from .ordered import scan


def linear_recurrences(
    df: DataFrame, keys: list[str], order: list[str], maps: dict[str, tuple[Column, ...]], *, y0: float | None = 0.0, chunk: int = 512, span: int | None = None, before: bool = False
) -> DataFrame:
    """``df`` plus a column for each (a, b) of ``maps``. The first row of a key sees y0; if that is None, it takes the third
    column of its map. With ``before`` the value before each row is added too, as ``<name>_before``. Rows that tie in ``order``
    are ordered arbitrarily.

    1. Rows are sorted within spans of their first order column and go through ``_running`` in batches: each gets its number, dealt
       into chunks of ``chunk`` rows, and the map of all rows of its chunk up to it. Without ``span`` a key is one span, which suits
       short keys only.
    2. A map is affine (k, b), and v, what it makes of no value; the one of a chunk's last row is the chunk's.
    3. Chunks' maps are staged, since each level of ``ordered.scan`` reads them, which composes those of all earlier chunks; each
       row's map is applied to what comes out.

    No rows are collected, so a hot key is many groups and none of them is in memory. All recurrences share the pass, so a further
    one costs no further shuffle.
    """
    outs = list(maps)
    each = range(len(outs))
    nothing = F.lit(None).cast("double")
    coefficients = {f"_{n}{i}": (*maps[out], nothing)[j].cast("double") for i, out in enumerate(outs) for j, n in enumerate("abf")}
    rows = df.withColumn("_t", F.floor(F.col(order[0]) / span).cast("bigint") if span else F.lit(0).cast("bigint"))
    rows = rows.withColumns(coefficients).repartition(*keys, "_t").sortWithinPartitions(*keys, "_t", *order)
    parts = _parts(y0 is None, before)
    points = [f"{n}{i}" for i in each for n in parts]
    made = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ("_t", "_n")), *(StructField(f"_{p}", DoubleType()) for p in points)])
    placed = rows.mapInArrow(_running([*keys, "_t"], df.columns, len(outs), chunk, y0 is None, before), made)
    placed = placed.withColumns({"_big": F.floor(F.col("_t") / 256).cast("bigint"), "_s": F.floor((F.col("_n") - 1) / chunk).cast("bigint")})
    levels = ["_big", "_t", "_s"]
    whole = F.struct(*((F.col(f"_{n}{i}") if n in parts else nothing).alias(f"{n}{i}") for i in each for n in "kbv"))
    chunks = staged(placed.groupBy(*keys, *levels).agg(F.max_by(whole, "_n").alias("_map")))
    identity = F.struct(*(x for i in each for x in (F.lit(1.0).alias(f"k{i}"), F.lit(0.0).alias(f"b{i}"), nothing.alias(f"v{i}"))))

    def joined(m: Column, k: Callable[[int], Column], b: Callable[[int], Column], v: Callable[[int], Column]) -> Column:
        fields = []
        for i in each:
            fields += [
                (m[f"k{i}"] * k(i)).alias(f"k{i}"),
                (m[f"b{i}"] * k(i) + b(i)).alias(f"b{i}"),
                F.when(m[f"v{i}"].isNull(), v(i)).otherwise(m[f"v{i}"] * k(i) + b(i)).alias(f"v{i}"),
            ]
        return F.struct(*fields)

    carry = scan(chunks.select(*keys, *levels, "_map"), keys, levels, "_map", identity, lambda m, n: joined(m, lambda i: n[f"k{i}"], lambda i: n[f"b{i}"], lambda i: n[f"v{i}"]))
    come = lambda i: F.col(f"_carry.v{i}") if y0 is None else F.col(f"_carry.k{i}") * float(y0) + F.col(f"_carry.b{i}")

    def value(i: int, p: str = "") -> Column:
        y = F.col(f"_{p}k{i}") * come(i) + F.col(f"_{p}b{i}")
        return F.when(come(i).isNull() | F.col(f"_{p}k{i}").isNull(), F.col(f"_{p}v{i}")).otherwise(y) if y0 is None else y

    done = placed.join(carry, [*keys, *levels])
    extra = [value(i, "p").alias(f"{out}_before") for i, out in enumerate(outs)] if before else []
    return done.select(*df.columns, *(value(i).alias(out) for i, out in enumerate(outs)), *extra)


def _parts(seeded: bool, before: bool) -> list[str]:
    """What a row's map has; v only where the first value seeds the recurrence, and the map before the row if that is asked for."""
    own = ["k", "b", *(["v"] if seeded else [])]
    return [*own, *(f"p{n}" for n in own if before)]


def _running(by: list[str], columns: list[str], n: int, chunk: int, seeded: bool, before: bool) -> Callable[[Iterator], Iterator]:
    """Sorted batches plus each row's number within ``by`` and, for each of ``n`` recurrences, the map of its chunk's rows up to it (and before it)."""
    parts = _parts(seeded, before)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [*columns, "_t", "_n", *(f"_{p}{i}" for i in range(n) for p in parts)]
        last, number, states = None, 0, [(1.0, 0.0, None)] * n
        for batch in batches:
            numbers = []
            for at in zip(*(batch.column(c).to_pylist() for c in by), strict=True):
                number = number + 1 if at == last else 1
                last = at
                numbers.append(number)
            first = [(at - 1) % chunk == 0 for at in numbers]
            out = []
            for i in range(n):
                k, b, v = states[i]
                ks, bs, vs = [k], [b], [v]  # the map before each row, but for first ones
                for new, a_, b_, f_ in zip(first, *(batch.column(f"_{c}{i}").to_pylist() for c in "abf"), strict=True):
                    if new:
                        k, b, v = 1.0, 0.0, None
                    if a_ is None or b_ is None:
                        k, b, v = None, None, f_ if v is None else None
                    else:
                        if k is not None:
                            k, b = k * a_, b * a_ + b_
                        if seeded:
                            v = f_ if v is None else v * a_ + b_
                    ks.append(k)
                    bs.append(b)
                    vs.append(v)
                states[i] = (k, b, v)
                maps = [(ks, 1.0), (bs, 0.0), *([(vs, None)] if seeded else [])]
                out += [pa.array(x[1:], pa.float64()) for x, _ in maps]
                if before:
                    out += [pa.array([start if new else y for new, y in zip(first, x)], pa.float64()) for x, start in maps]
            arrays = [*(batch.column(c) for c in [*columns, "_t"]), pa.array(numbers, pa.int64()), *out]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def linear_recurrence(df: DataFrame, keys: list[str], order: list[str], a: Column, b: Column, out: str, **options) -> DataFrame:
    return linear_recurrences(df, keys, order, {out: (a, b)}, **options)


def ema_map(value: str, span: int) -> tuple[Column, Column, Column]:
    """Exponential mean with alpha = 2 / (span + 1), seeded at the first value."""
    alpha = 2.0 / (span + 1)
    return F.lit(1 - alpha), alpha * F.col(value), F.col(value)


def wilder_map(value: str, period: int) -> tuple[Column, Column, Column]:
    """Wilder's mean: the first value, then ((n - 1) * previous + value) / n."""
    return F.lit((period - 1) / period), F.col(value) / period, F.col(value)


#: Bars of four days share a span; a key's spans are folded by levels.
SPAN_MS = 4 * 86_400_000


def means(df: DataFrame, keys: list[str], order: list[str], maps: dict[str, tuple[Column, ...]], *, span: int | None = SPAN_MS) -> DataFrame:
    """Several seeded means in one scan, without warm-up nulls. The first order column is a time in ms, or ``span`` is in its units."""
    return linear_recurrences(df, keys, order, maps, y0=None, span=span)


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, span: int, out: str) -> DataFrame:
    return means(df, keys, order, {out: ema_map(value, span)})


def wilder(df: DataFrame, keys: list[str], order: list[str], value: str, period: int, out: str) -> DataFrame:
    return means(df, keys, order, {out: wilder_map(value, period)})
