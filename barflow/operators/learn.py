"""Walk-forward training and prediction with gradient-boosted trees."""

from __future__ import annotations

import urllib.parse
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage_folder
from .folds import MIN_TRAIN, MIN_VALID, skip_reasons


def fit(rows: DataFrame, features: list[str], *, weight: str | None = None, trees: int = 20, depth: int = 5, seed: int = 42):
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, **({"weightCol": weight} if weight else {}))
    return model.fit(assembled)


def predict(model, rows: DataFrame, features: list[str]) -> DataFrame:
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    scored = model.transform(assembled)
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


#: The columns of the prediction table.
PREDICTION = (
    "run_id", "snapshot_id", "fold_index", "scenario", "model_scope", "model_symbol", "symbol", "timestamp_ms", "source", "y", "forward_return", "supervised_row_weight", "probability",
)


#: Fixed value: the scenario without which a run is no run.
REQUIRED = "weighted"


def walk_forward(
    assigned: DataFrame, features: list[str], *, weight: str, run_id: str, snapshot_id: str, trees: int = 20, min_train: int = MIN_TRAIN, min_valid: int = MIN_VALID,
    at_once: int = 4, folder: str | None = None, required: str | None = REQUIRED,
) -> DataFrame:
    """Predictions of the validation rows of every (scenario, fold): of the scenario's global model, and of each symbol's own.

    ``assigned`` has scenario, fold_index and role (``folds.scenarios``, ``folds.assign``). It is stored under ``folder`` by (scenario,
    fold_index, symbol), so that a fit reads the files of its own partitions; predictions are written there as each job ends, by
    (fold_index, scenario, model_scope, model_symbol), and the result reads these folders (``prediction_scan`` does as well).

    What ``folds.skip_reasons`` names is not fitted: its two small tables decide. A fold of the ``required`` scenario that would have
    to be skipped is an error. ``native_only`` rows are not weighted. Fits are Spark jobs, ``at_once`` of them at a time; the loop
    runs over (scenario, fold, symbol), never over rows. Nothing to fit: no rows.
    """
    spark = assigned.sparkSession
    folder = folder or stage_folder(spark)
    by = ["scenario", "fold_index", "symbol"]
    assigned.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/assigned")
    stored = spark.read.schema(assigned.schema).parquet(f"{folder}/assigned")
    reasons = skip_reasons(stored, ("scenario", "fold_index")).collect()
    for r in sorted(reasons, key=lambda r: r["fold_index"]):
        if r["scenario"] == required and r["reason"] is not None:
            raise ValueError(f"fold={r['fold_index']} scenario={required} {r['reason']}")
    whole = {(r["scenario"], r["fold_index"]) for r in reasons if r["reason"] is None}
    own = skip_reasons(stored, ("scenario", "fold_index", "symbol"), min_train=min_train, min_valid=min_valid).where("reason is null").collect()
    jobs = sorted([(*k, None) for k in whole] + [(r["scenario"], r["fold_index"], r["symbol"]) for r in own if (r["scenario"], r["fold_index"]) in whole], key=lambda j: (j[0], j[1], j[2] or ""))
    parts = ["fold_index", "scenario", "model_scope", "model_symbol"]

    def run(job: tuple) -> str:
        scenario, fold, symbol = job
        rows = stored.where((F.col("scenario") == scenario) & (F.col("fold_index") == fold))
        rows = rows if symbol is None else rows.where(F.col("symbol") == symbol)
        model = fit(rows.where("role = 'train'"), features, weight=None if scenario == "native_only" else weight, trees=trees)
        names = {"run_id": run_id, "snapshot_id": snapshot_id, "model_scope": "global" if symbol is None else "symbol"}
        scored = predict(model, rows.where("role = 'valid'"), features).withColumns({k: F.lit(v) for k, v in names.items()})
        name = urllib.parse.quote(symbol or "", safe="")
        path = f"{folder}/predictions/fold_index={fold}/scenario={scenario}/model_scope={names['model_scope']}/model_symbol={name or '__HIVE_DEFAULT_PARTITION__'}"
        scored.select(*(c for c in PREDICTION if c not in parts)).write.mode("overwrite").parquet(path)
        return path

    kinds = {"run_id": "string", "snapshot_id": "string", "model_scope": "string", "model_symbol": "string", "probability": "double"}
    schema = ", ".join(f"{c} {kinds[c] if c in kinds else assigned.schema[c].dataType.simpleString()}" for c in PREDICTION)
    with ThreadPoolExecutor(at_once) as pool:
        made = list(pool.map(run, jobs))
    return spark.read.schema(schema).parquet(f"{folder}/predictions").select(*PREDICTION) if made else spark.createDataFrame([], schema)


def refit(rows: DataFrame, features: list[str], *, weight: str, trees: int = 20, min_rows: int = 1000, symbols: list[str] | None = None) -> dict:
    """Models on the whole history: the global one under None, and one for each eligible symbol with enough rows of both classes."""
    models = {None: fit(rows, features, weight=weight, trees=trees)}
    counts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes"))
    enough = {r["symbol"] for r in counts.where((F.col("n") >= min_rows) & (F.col("classes") == 2) & F.col("symbol").isin(symbols or [])).collect()}
    for symbol in sorted(enough):
        models[symbol] = fit(rows.where(F.col("symbol") == symbol), features, weight=weight, trees=trees)
    return models
