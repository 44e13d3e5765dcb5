"""Cost-aware metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import prefix_sums

#: Fixed value: probabilities stay this far from 0 and 1.
CLIP = 1e-6


DAY_MS = 86_400_000
#: What metrics are made for, besides symbols and splits.
KEYS = ("fold", "scenario", "scope")


def own_split() -> Column:
    return F.when(F.col("source") == "native", "native").otherwise("synthetic")


def splits(preds: DataFrame) -> DataFrame:
    """Every row in the split ``all`` and in ``native`` or ``synthetic`` (fills included)."""
    return preds.withColumn("split", F.explode(F.array(F.lit("all"), own_split())))


#: The splits of predictions, the symbols' own rows and those of all symbols.
SPLITS, SYMBOLS = ("all", "native", "synthetic"), ("own", "*")


def _listed(symbols: tuple[str, ...]) -> Column:
    return F.explode(F.array(*(F.lit("*") if s == "*" else F.col("symbol") for s in symbols)))


def _grains(rows: DataFrame, symbols: tuple[str, ...] = SYMBOLS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Rows of (symbol, own split) also under the split ``all`` and the symbol ``*``, as far as these are asked for."""
    wide = rows.withColumn("split", F.lit("all") if splits == ("all",) else F.explode(F.array(F.lit("all"), F.col("split"))))
    return wide.where(F.col("split").isin(*splits)).withColumn("symbol", _listed(symbols))


def _trading(threshold: float, fee: float) -> list[Column]:
    trade = F.col("probability") >= threshold
    net = F.when(trade, F.col("forward_return") - 2 * fee)
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(trade).alias("trades"),
        F.coalesce(F.sum(F.when(trade, F.col("forward_return"))), F.lit(0.0)).alias("gross_return"),
        F.coalesce(F.sum(net), F.lit(0.0)).alias("net_return"),
        F.avg((net > 0).cast("double")).alias("win_rate"),
    ]


def _losses() -> list[Column]:
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("probability")))
    y = F.col("y")
    return [F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("logloss"), F.avg(F.pow(p - y, F.lit(2.0))).alias("brier")]


def trading(preds: DataFrame, keys: list[str], *, threshold: float, fee: float) -> DataFrame:
    """Rows, trades (probability at least ``threshold``), gross and net return, win rate (null without trades)."""
    return preds.groupBy(*keys).agg(*_trading(threshold, fee))


def drawdown(preds: DataFrame, keys: list[str], order: list[str], *, threshold: float, fee: float, bucket_ms: int | None = DAY_MS) -> DataFrame:
    """Largest fall of the cumulative net return from its running maximum; the maximum starts at the first value.

    ``order`` is chronological by default use, its first column a time in ms; put the symbol first to follow file order instead
    and pass no ``bucket_ms``. Trades of equal time need a further column to be ordered. Keys without trades give 0.
    """
    net = F.when(F.col("probability") >= threshold, F.col("forward_return") - 2 * fee)
    found = _falls(preds.withColumn("_net", net).where("_net is not null"), keys, order, bucket_ms)
    return preds.select(*keys).distinct().join(found, keys, "left").fillna(0.0, ["max_drawdown"])


def _falls(trades: DataFrame, keys: list[str], order: list[str], bucket_ms: int | None) -> DataFrame:
    """Rows are ordered within time buckets alone; a bucket is reduced to its sum, extremes and own fall, and only the buckets
    of a key are ordered as a whole, so a key of all trades is never sorted in one task."""
    bucket = F.floor(F.col(order[0]) / bucket_ms) if bucket_ms else F.lit(0)
    parts = _paths(trades.withColumn("_b", bucket), ["_b", *keys], order, {"": F.col("_net")})
    return _chained(parts, keys, ["_b"]).select(*keys, F.col("fall").alias("max_drawdown"))


def trade_runs(preds: DataFrame, *, thresholds: dict[str, float], fee: float, order: list[str], keys: tuple[str, ...] = KEYS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Trades at each of ``thresholds`` (by name), where ``order`` begins with a time and the symbol, reduced to one row per (keys, time, symbol).

    Rows of a time and symbol are neighbours at every threshold and in every split, of the symbol as of all symbols: they are ordered
    once and reduced to what ``_falls`` keeps of a bucket.
    """
    net, score = F.col("forward_return") - 2 * fee, F.col("probability")
    of = lambda split: F.lit(True) if split == "all" else own_split() == split
    nets = {f"_{name}_{split}": F.when((score >= least) & of(split), net) for name, least in thresholds.items() for split in splits}
    return _paths(preds.where(score >= min(thresholds.values())), [order[0], "symbol", *keys], order[2:] or order[:1], nets)


def falls_of(runs: DataFrame, name: str, *, order: list[str], keys: tuple[str, ...] = KEYS, bucket_ms: int | None = DAY_MS, symbols: tuple[str, ...] = SYMBOLS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """``max_drawdown`` per (keys, symbol or ``*``, split) at the threshold ``name`` of ``trade_runs``."""
    by = [*keys, "symbol", "split"]
    parts = ("s", "top", "low", "fall")
    sets = F.array(*(F.struct(F.lit(x).alias("split"), *(F.col(f"{c}_{name}_{x}").alias(c) for c in parts)) for x in splits))
    rows = runs.select(*keys, order[0], "symbol", F.explode(sets).alias("x")).select(*keys, order[0], F.col("symbol").alias("_real"), _listed(symbols).alias("symbol"), "x.*").where("s is not null")
    buckets = rows.withColumn("_b", F.floor(F.col(order[0]) / bucket_ms) if bucket_ms else F.lit(0))
    return _chained(_chained(buckets, ["_b", *by], [order[0], "_real"]), by, ["_b"]).select(*by, F.col("fall").alias("max_drawdown"))


def _paths(rows: DataFrame, by: list[str], order: list[str], nets: dict[str, Column]) -> DataFrame:
    """Sum, highest and lowest running sum and largest fall of each of ``nets`` per ``by``, nulls left out; what parts rows comes first in ``by``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumns({f"_net{n}": net for n, net in nets.items()}).withColumns({f"_cum{n}": F.sum(f"_net{n}").over(w) for n in nets})
    cum = cum.withColumns({f"_fall{n}": F.max(f"_cum{n}").over(w) - F.col(f"_cum{n}") for n in nets})
    return cum.groupBy(*by).agg(*(x for n in nets for x in (F.sum(f"_net{n}").alias(f"s{n}"), F.max(f"_cum{n}").alias(f"top{n}"), F.min(f"_cum{n}").alias(f"low{n}"), F.max(f"_fall{n}").alias(f"fall{n}"))))


def _chained(parts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Parts of a path, one after another, as one."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0.0))).withColumn("high", F.max(F.col("base") + F.col("top")).over(before))
    at = lambda c: F.col("base") + F.col(c)
    return placed.groupBy(*by).agg(F.sum("s").alias("s"), F.max(at("top")).alias("top"), F.min(at("low")).alias("low"), F.max(F.greatest("fall", F.col("high") - at("low"))).alias("fall"))


def probability_loss(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Log-loss and Brier score, probabilities clipped to [1e-6, 1 - 1e-6]."""
    return preds.groupBy(*keys).agg(*_losses())


def _by_score(tied: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative counts over distinct scores, highest first, so that ties are one step. Scores lie in cells of 2^-10 and 2^-20;
    windows hold cells of a coarser one, or the scores of a fine one."""
    cell = lambda bits: F.coalesce(-F.floor(F.col("probability") * (1 << bits)).cast("bigint"), F.lit(1 << 60))
    run = prefix_sums(tied, keys, [cell(10), cell(20)], [F.desc("probability")], {"_tp": F.col("tp"), "_fp": F.col("fp")})
    whole = tied.groupBy(*keys).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    return run.join(whole, keys).withColumns({"ctp": F.col("_tp") + F.col("tp"), "cfp": F.col("_fp") + F.col("fp")})


def _tied(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys, "probability").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))


def ranking(preds: DataFrame, keys: list[str]) -> DataFrame:
    """ROC-AUC and average precision with ties grouped; null where one class is missing."""
    return _ranked(_tied(preds, keys), keys)


def _ranked(tied: DataFrame, keys: list[str]) -> DataFrame:
    c = _by_score(tied, keys)
    area = F.col("fp") * (F.col("ctp") - F.col("tp") / 2)
    step = F.col("tp") * (F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    agg = c.groupBy(*keys).agg(F.sum(area).alias("a"), F.sum(step).alias("s"), F.first("P").alias("P"), F.first("N").alias("N"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(*keys, F.when(both, F.col("a") / (F.col("P") * F.col("N"))).alias("roc_auc"), F.when(both, F.col("s") / F.col("P")).alias("pr_auc"))


def by_score(preds: DataFrame, *, fee: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Predictions added up per (keys, symbol, own split, probability): what all metrics but the drawdown are made of, at any threshold.
    ``y`` is 0 or 1; nulls of it and of ``forward_return`` are left out of the averages."""
    net = F.col("forward_return") - 2 * fee
    return preds.withColumn("split", own_split()).groupBy(*keys, "symbol", "split", "probability").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(net).alias("judged"), F.sum("forward_return").alias("gross_return"), F.sum(net).alias("net_return"), F.count_if(net > 0).alias("wins"),
        F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"),
    )


def ranks_of(scores: DataFrame, *, keys: tuple[str, ...] = KEYS, symbols: tuple[str, ...] = SYMBOLS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """``ranking`` of rows of ``by_score`` per (keys, symbol or ``*``, split); no threshold is in it."""
    by = [*keys, "symbol", "split"]
    rows = _grains(scores.select(*by, "probability", "tp", "fp"), symbols, splits)
    return _ranked(rows.groupBy(*by, "probability").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")), by)


def metrics_of(scores: DataFrame, falls: DataFrame, ranks: DataFrame, *, threshold: float, keys: tuple[str, ...] = KEYS, symbols: tuple[str, ...] = SYMBOLS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """One row per (keys, symbol or ``*``, split) from ``by_score``, ``falls_of`` and ``ranks_of``. Splits other than ``splits`` have
    neither drawdown nor ranking, all else is there for each."""
    by = [*keys, "symbol", "split"]
    trade = F.col("probability") >= threshold
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("probability")))
    sums = scores.groupBy(*by).agg(
        F.sum("row_count").alias("row_count"), *(F.coalesce(F.sum(F.when(trade, F.col(c))), F.lit(0)).alias(n) for c, n in (("row_count", "trades"), ("judged", "judged"), ("wins", "wins"))),
        *(F.sum(F.when(trade, F.col(c))).alias(c) for c in ("gross_return", "net_return")), F.sum(F.col("tp") + F.col("fp")).alias("marked"),
        F.sum(-(F.col("tp") * F.log(p) + F.col("fp") * F.log(1 - p))).alias("logloss"), F.sum(F.col("tp") * (1 - p) * (1 - p) + F.col("fp") * p * p).alias("brier"),
    )
    names = ("row_count", "trades", "judged", "wins", "gross_return", "net_return", "marked", "logloss", "brier")
    wide = _grains(sums, symbols).groupBy(*by).agg(*(F.sum(c).alias(c) for c in names)).dropna(subset=by)
    none = F.lit(0.0)
    base = wide.select(
        *by, "row_count", "trades", F.coalesce("gross_return", none).alias("gross_return"), F.coalesce("net_return", none).alias("net_return"),
        F.when(F.col("judged") > 0, F.col("wins") / F.col("judged")).alias("win_rate"), *(F.when(F.col("marked") > 0, F.col(c) / F.col("marked")).alias(c) for c in ("logloss", "brier")),
    )
    both = base.join(falls, by, "left").join(ranks, by, "left")
    return both.withColumn("max_drawdown", F.when(F.col("split").isin(*splits), F.coalesce("max_drawdown", none)))


def _measured(preds: DataFrame, threshold: float, fee: float, order: list[str], keys: tuple[str, ...], bucket_ms: int | None, grain: dict[str, tuple[str, ...]]) -> DataFrame:
    scores = by_score(preds, fee=fee, keys=keys)
    if order[1:2] == ["symbol"]:
        runs = trade_runs(preds, thresholds={"entry": threshold}, fee=fee, order=order, keys=keys, splits=grain["splits"])
        falls = falls_of(runs, "entry", order=order, keys=keys, bucket_ms=bucket_ms, **grain)
    else:
        by = [*keys, "symbol", "split"]
        taken = preds.where(F.col("probability") >= threshold).withColumns({"split": own_split(), "_net": F.col("forward_return") - 2 * fee})
        falls = _falls(_grains(taken.select(*by, *(c for c in order if c not in by), "_net"), **grain), by, order, bucket_ms)
    return metrics_of(scores, falls, ranks_of(scores, keys=keys, **grain), threshold=threshold, keys=keys, **grain).where(F.col("split").isin(*grain["splits"]))


def fold_metrics(preds: DataFrame, *, threshold: float, fee: float, order: list[str], keys: tuple[str, ...] = KEYS, bucket_ms: int | None = DAY_MS) -> DataFrame:
    """One row per (keys, symbol or ``*`` for all, split) with all metrics.

    Rows are summed up once per (keys, symbol, own split, score); the coarser grains add up those sums. Trades
    are ordered once for all grains if ``order`` begins with a time and ``symbol``, which is the row's own there; in another order they
    are laid out for every grain. ``order`` begins with a time in ms, or ``bucket_ms`` is None.
    """
    return _measured(preds, threshold, fee, order, keys, bucket_ms, {"symbols": SYMBOLS, "splits": SPLITS})


def total_metrics(preds: DataFrame, *, threshold: float, fee: float, order: list[str], keys: tuple[str, ...] = KEYS, bucket_ms: int | None = DAY_MS) -> DataFrame:
    """The rows of ``fold_metrics`` for the symbol ``*`` and the split ``all`` alone, as gates need them at their own threshold."""
    return _measured(preds, threshold, fee, order, keys, bucket_ms, {"symbols": ("*",), "splits": ("all",)})


def summary(metrics: DataFrame) -> DataFrame:
    """Over folds, all rows and symbols: counts and returns added up, others averaged without nulls."""
    rows = metrics.where("split = 'all' and symbol = '*'")
    return rows.groupBy("scenario", "scope").agg(
        *(F.sum(c).alias(c) for c in ("row_count", "trades", "gross_return", "net_return")),
        *(F.avg(c).alias(c) for c in ("win_rate", "max_drawdown", "logloss", "brier", "roc_auc", "pr_auc")),
        F.count(F.lit(1)).alias("folds"),
    )


def primary_scenario(summaries: DataFrame) -> DataFrame:
    """The global scenario with the best (net return, average precision, name)."""
    best = F.max_by("scenario", F.struct(F.coalesce("net_return", F.lit(0.0)), F.coalesce("pr_auc", F.lit(0.0)), F.col("scenario")))
    return summaries.where("scope = 'global'").agg(best.alias("primary_scenario"))


def stressed(net, trades, slip: float):
    return net - 2 * trades * slip
