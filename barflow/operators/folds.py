"""Walk-forward folds over whole months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import add_months, month_key

#: Least rows of a fold.
MIN_TRAIN, MIN_VALID = 1000, 100


def full_months(rows: DataFrame, *, interval_ms: int, ts: str = "timestamp_ms") -> DataFrame:
    """Months that the data cover whole: the first only if it starts with it, the last only if it reaches its last interval."""
    edge = rows.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    start = lambda c: F.date_trunc("month", F.timestamp_millis(c))
    first = F.when(F.unix_millis(start("a")) == F.col("a"), start("a")).otherwise(F.add_months(start("a"), 1).cast("timestamp"))
    end = F.add_months(start("b"), 1).cast("timestamp")
    last = F.when(F.col("b") >= F.unix_millis(end) - interval_ms, start("b")).otherwise(F.add_months(start("b"), -1).cast("timestamp"))
    span = edge.where("a is not null").select(first.cast("date").alias("f"), last.cast("date").alias("l")).where("f <= l")
    return span.select(F.explode(F.expr("sequence(f, l, interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def walk_forward_folds(months: DataFrame, *, train: int, valid: int, step: int, last: int) -> DataFrame:
    """The last folds that fit, numbered from 1; fewer full months than a fold needs are an error when the result is used.

    The months are few: they are counted in one row.
    """
    if min(train, valid, step, last) <= 0:
        raise ValueError("walk-forward windows, step and folds must be above 0")
    span = months.agg(F.min("month").alias("first"), F.count(F.lit(1)).alias("n"))
    short = F.raise_error(F.concat(F.lit("insufficient full months for walk-forward folds: have="), F.col("n").cast("string"), F.lit(f" need>={train + valid}")))
    total = F.when(F.col("n") >= train + valid, F.floor((F.col("n") - train - valid) / step) + 1).otherwise(short.cast("bigint"))
    folds = span.select("first", total.alias("total")).select("first", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1)).alias("k"))
    at = lambda months_on: add_months(F.col("first"), (F.col("k") * step + months_on).cast("int"))
    kept = folds.where(F.col("k") >= F.col("total") - last)
    number = F.col("k") - F.greatest(F.col("total") - last, F.lit(0)) + 1
    return kept.select(
        number.cast("int").alias("fold_index"), at(F.lit(0)).alias("train_start"), at(F.lit(train - 1)).alias("train_end"), at(F.lit(train)).alias("valid_start"), at(F.lit(train + valid - 1)).alias("valid_end")
    )


def assign(rows: DataFrame, folds: DataFrame, *, ts: str = "timestamp_ms") -> DataFrame:
    """Rows with each fold and role (train, valid) whose months hold them. Folds become one small table of (month, fold, role), so it is an equi-join."""
    month_list = lambda a, b: F.expr(f"transform(sequence(to_date(concat({a}, '-01')), to_date(concat({b}, '-01')), interval 1 month), d -> date_format(d, 'yyyy-MM'))")
    roles = [folds.select("fold_index", F.lit(r).alias("role"), F.explode(month_list(f"{r}_start", f"{r}_end")).alias("month")) for r in ("train", "valid")]
    return rows.withColumn("month", month_key(F.col(ts))).join(roles[0].unionByName(roles[1]), "month")


def scenarios(rows: DataFrame) -> DataFrame:
    """Every row as ``weighted``, native ones as ``native_only`` too."""
    names = F.when(F.col("source") == "native", F.array(F.lit("weighted"), F.lit("native_only"))).otherwise(F.array(F.lit("weighted")))
    return rows.withColumn("scenario", F.explode(names))


def skip_reasons(assigned: DataFrame, keys: tuple[str, ...], *, min_train: int = MIN_TRAIN, min_valid: int = MIN_VALID) -> DataFrame:
    """Per key: counts, and the first reason to skip, null if none applies.

    A key with ``symbol`` is a symbol's own model: least rows come first, then both classes. Other keys are whole scenarios: no
    least rows, but rows and both classes in training and validation.
    """
    of = lambda role: F.col("role") == role
    labels = lambda role: F.sort_array(F.collect_set(F.when(of(role), F.col("y").cast("int")))).alias(f"{role}_labels")  # noqa: E731  of 0 and 1
    agg = assigned.groupBy(*keys).agg(F.count_if(of("train")).alias("train_rows"), F.count_if(of("valid")).alias("valid_rows"), labels("train"), labels("valid"))
    one_class = lambda role: F.size(f"{role}_labels") != 2
    seen = lambda role: F.concat(F.lit(f"{role} must contain both classes, observed=["), F.array_join(f"{role}_labels", ", "), F.lit("]"))
    #: The texts of the reasons.
    if "symbol" in keys:
        reason = (
            F.when(F.col("train_rows") < min_train, f"train_rows_lt_{min_train}").when(F.col("valid_rows") < min_valid, f"valid_rows_lt_{min_valid}")
            .when(one_class("train"), "train_missing_class").when(one_class("valid"), "valid_missing_class")
        )
    else:
        reason = (
            F.when(F.col("train_rows") == 0, "train has no rows").when(F.col("valid_rows") == 0, "valid has no rows")
            .when(one_class("train"), seen("train")).when(one_class("valid"), seen("valid"))
        )
    return agg.select(*keys, "train_rows", "valid_rows", reason.alias("reason"))


def fold_audit(assigned: DataFrame) -> DataFrame:
    """Rows and source mix of each fold."""
    counts = assigned.groupBy("fold_index", "role", "source").agg(F.count(F.lit(1)).alias("n"))
    of = lambda r, s: F.sum(F.when((F.col("role") == r) & (F.col("source") == s if s else F.lit(True)), F.col("n")).otherwise(0))
    tags = ("native", "synthetic", "synthetic_fill")
    return counts.groupBy("fold_index").agg(*(of(r, None).alias(f"{r}_rows") for r in ("train", "valid")), *(of(r, s).alias(f"{r}_{s}") for r in ("train", "valid") for s in tags))


def scenario_status(reasons: DataFrame, *, required: str | None = None) -> DataFrame:
    """trained if every fold is there, partial if some are, else skipped. A fold of the ``required`` scenario that has to be
    skipped is an error when the result is used."""
    if required is not None:
        missed = (F.col("scenario") == required) & F.col("reason").isNotNull()
        said = F.concat(F.lit("fold="), F.col("fold_index").cast("string"), F.lit(f" scenario={required} "), F.col("reason"))
        reasons = reasons.withColumn("reason", F.when(missed, F.raise_error(said).cast("string")).otherwise(F.col("reason")))
    agg = reasons.groupBy("scenario").agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("reason").isNull()).alias("completed"))
    status = F.when(F.col("completed") == F.col("folds"), "trained").when(F.col("completed") > 0, "partial").otherwise("skipped")
    return agg.withColumn("status", status)


def blend(preds: DataFrame, *, keys: list[str], enough: int, symbol_share: float = 0.7) -> DataFrame:
    """.7 symbol + .3 global score where a symbol's own model has enough rows, else the global score."""
    grouped = preds.groupBy(*keys).agg(
        F.avg(F.when(F.col("scope") == "global", F.col("probability"))).alias("g"), F.avg(F.when(F.col("scope") == "symbol", F.col("probability"))).alias("s")
    )
    coverage = grouped.groupBy("symbol").agg(F.count("s").alias("covered"))
    both = (F.col("covered") >= enough) & F.col("s").isNotNull() & F.col("g").isNotNull()
    joined = grouped.join(coverage, "symbol")
    return joined.select(*keys, F.when(both, symbol_share * F.col("s") + (1 - symbol_share) * F.col("g")).otherwise(F.coalesce("g", "s")).alias("score"))
