"""Per-symbol attribution, weakness classes and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import latest
from .metrics import stressed

#: Bounds below (above, for the drawdown) which a symbol is not promoted.
MIN_FOLDS, MIN_TRADES, MIN_ROWS, MAX_DRAWDOWN = 4, 100, 5000, 0.35


def symbol_attribution(metrics: DataFrame, *, slip: float) -> DataFrame:
    """Per (scenario, scope, symbol): sums over folds for each split, synthetic share of rows and stressed net return."""
    rows = metrics.where("symbol <> '*'")
    of = lambda split, c: F.coalesce(F.sum(F.when(F.col("split") == split, F.col(c))), F.lit(0))
    only = lambda split, c: F.sum(F.when(F.col("split") == split, F.col(c))).cast("double")  # noqa: E731  null without such rows
    is_all = F.col("split") == "all"
    agg = rows.groupBy("scenario", "scope", "symbol").agg(
        F.count_distinct(F.when(is_all, F.col("fold"))).alias("folds"),
        of("all", "row_count").alias("row_count"),
        of("all", "trades").alias("trades"),
        of("all", "gross_return").cast("double").alias("gross_return"),
        of("all", "net_return").cast("double").alias("net_return"),
        only("native", "net_return").alias("native_net"),
        only("synthetic", "net_return").alias("synthetic_net"),
        of("synthetic", "row_count").alias("synthetic_rows"),
        F.avg(F.when(is_all, F.col("roc_auc"))).alias("roc_auc"),
        F.avg(F.when(is_all, F.col("max_drawdown"))).alias("max_drawdown"),
    )
    share = F.col("synthetic_rows") / F.greatest(F.lit(1), F.col("row_count"))
    return agg.withColumns({"synthetic_share": share, "stressed_net": stressed(F.col("net_return"), F.col("trades"), slip)})


def weakness(rows: DataFrame, *, min_rows: int = MIN_ROWS, min_trades: int = MIN_TRADES, min_folds: int = MIN_FOLDS) -> DataFrame:
    """The first class that applies with its reasons, and eligibility for promotion (a drawdown bars it in any class and is a
    reason too). A symbol without rows of a split is never judged by that split."""
    few_folds, few_trades, few_rows, drawdown = f"folds_lt_{min_folds}", f"trades_lt_{min_trades}", f"row_count_lt_{min_rows}", f"max_drawdown_gt_{MAX_DRAWDOWN:.2f}"
    #: The reasons' names.
    reasons = {
        few_folds: F.col("folds") < min_folds,
        few_trades: F.col("trades") < min_trades,
        few_rows: F.col("row_count") < min_rows,
        "fees_erase_edge": (F.col("gross_return") > 0) & (F.col("net_return") <= 0),
        "slippage_stress_non_positive": F.col("stressed_net") <= 0,
        "synthetic_dominant_negative": (F.col("synthetic_share") >= 0.70) & (F.col("synthetic_net") < 0),
        "synthetic_underperforms_native": F.col("synthetic_net") <= F.col("native_net") - 1,
        "net_return_negative": F.col("net_return") < 0,
        "roc_auc_lt_0.52": F.col("roc_auc") < 0.52,
        drawdown: F.col("max_drawdown") > MAX_DRAWDOWN,
    }
    groups = {"sparse_history": (few_folds, few_trades, few_rows), "cost_fragility": ("fees_erase_edge", "slippage_stress_non_positive"),
              "synthetic_fragility": ("synthetic_dominant_negative", "synthetic_underperforms_native"), "weak_signal": ("net_return_negative", "roc_auc_lt_0.52")}
    group_of = {m: g for g, members in groups.items() for m in members}
    kind: Column | None = None
    for name, members in groups.items():
        hit = F.coalesce(reasons[members[0]], F.lit(False))
        for m in members[1:]:
            hit = hit | F.coalesce(reasons[m], F.lit(False))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    out = rows.withColumn("kind", kind.otherwise("none"))
    decides = lambda n: F.lit(True) if n == drawdown else F.col("kind") == group_of[n]
    listed = F.filter(F.array(*(F.when(c & decides(n), n) for n, c in reasons.items())), lambda r: r.isNotNull())
    return out.withColumns({"reasons": F.array_join(listed, ","), "eligible": (F.col("kind") == "none") & ~F.coalesce(reasons[drawdown], F.lit(False))})


def worst_symbols(rows: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("scenario", "scope").orderBy("stressed_net", "net_return", "symbol")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_breach(report: DataFrame, *, max_gaps: int, min_coverage: float) -> DataFrame:
    """One row: the gate, symbol, observed and required value of the first symbol with too many gaps or too little coverage, else nulls."""
    gaps = F.col("gap_count") > max_gaps
    found = F.when(gaps, F.struct(F.lit("combined_gap_count").alias("gate"), F.col("gap_count").cast("double").alias("observed"), F.lit(float(max_gaps)).alias("required"))).when(
        F.col("coverage_pct") < min_coverage, F.struct(F.lit("combined_coverage").alias("gate"), F.col("coverage_pct").cast("double").alias("observed"), F.lit(float(min_coverage)).alias("required"))
    )
    return report.select("symbol", found.alias("b")).where("b is not null").agg(F.min_by("b", "symbol").alias("breach"), F.min("symbol").alias("breach_symbol"))


def gates(facts: DataFrame, *, slip: float, min_folds: int, min_trades: int, max_drawdown: float = MAX_DRAWDOWN, min_pass_rate: float = 0.6) -> DataFrame:
    """Failed gates per scenario as rows (gate, observed, required); a null drawdown fails, native_only skips the pass rate,
    which otherwise must be known. ``breach`` is the first symbol's of ``first_breach``, null if none breaches.
    """
    d = lambda x: x.cast("double")
    stress = stressed(F.col("net_return"), F.col("trades"), slip)
    rules = [
        ("min_folds", d(F.col("folds")), float(min_folds), F.col("folds") < min_folds),
        ("min_trades", d(F.col("trades")), float(min_trades), F.col("trades") < min_trades),
        ("net_positive", F.col("net_return"), 0.0, F.col("net_return") <= 0),
        ("max_drawdown", F.col("max_drawdown"), max_drawdown, F.col("max_drawdown").isNull() | (F.col("max_drawdown") > max_drawdown)),
        ("slippage_stress_positive", stress, 0.0, stress <= 0),
        ("snapshot_parity", d(F.col("parity").cast("int")), 1.0, ~F.col("parity")),
        ("conversion_pass_rate", F.col("pass_rate"), min_pass_rate, (F.col("scenario") != "native_only") & (F.coalesce("pass_rate", F.lit(0.0)) < min_pass_rate)),
    ]
    items = [F.when(bad, F.struct(F.lit(g).alias("gate"), o.alias("observed"), F.lit(r).alias("required"))) for g, o, r, bad in rules]
    items = F.array(*items, *([F.col("breach")] if "breach" in facts.columns else []))
    return facts.select("scenario", F.explode_outer(F.filter(items, lambda x: x.isNotNull())).alias("x")).select("scenario", "x.gate", "x.observed", "x.required")


def choose(facts: DataFrame, failures: DataFrame) -> DataFrame:
    """The scenario to promote: passing first, then fewest failures, folds, net return, average precision, name."""
    failed = failures.groupBy("scenario").agg(F.count("gate").alias("failed"))
    joined = facts.join(failed, "scenario", "left").fillna(0, ["failed"])
    key = F.struct((F.col("failed") == 0).cast("int"), -F.col("failed"), F.col("folds"), F.col("net_return"), F.coalesce("pr_auc", F.lit(0.0)), F.col("scenario"))
    return joined.agg(F.max_by("scenario", key).alias("scenario"), F.max_by("failed", key).alias("failed"))


def promotion_record(choice: DataFrame, symbols: DataFrame, failures: DataFrame) -> DataFrame:
    """Decision and soft warnings as rows: omitted symbols, the five worst, and other scenarios with their failed gates."""
    decision = choice.select(F.lit("decision").alias("type"), "scenario", F.when(F.col("failed") == 0, "accepted").otherwise("rejected").alias("detail"))
    mine = symbols.where("scope = 'global'").join(choice.select("scenario"), "scenario")
    omitted = mine.where(~F.col("eligible")).select(F.lit("omitted").alias("type"), "scenario", F.col("symbol").alias("detail"))
    worst = worst_symbols(mine, 5).select(F.lit("worst").alias("type"), "scenario", F.col("symbol").alias("detail"))
    others = failures.join(choice.select("scenario"), "scenario", "left_anti").where("gate is not null").select(F.lit("alternative").alias("type"), "scenario", F.col("gate").alias("detail"))
    return decision.unionByName(omitted).unionByName(worst).unionByName(others)
