"""Run log and champion / challenger selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS_SCHEMA = "run_id string, model_type string, version int, stage string, metric string, value double"


def log_run(spark: SparkSession, run_id: str, model_type: str, version: int, metrics: dict[str, float],
            stage: str = "val") -> DataFrame:
    """G1: one row per finite metric (non-finite values are dropped)."""
    rows = [(run_id, model_type, version, stage, k, float(v)) for k, v in metrics.items()
            if v is not None and math.isfinite(float(v))]
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def append_runs(runs: DataFrame, path: str) -> None:
    """Crash-safe partial results: every run is appended as it finishes."""
    runs.write.mode("append").parquet(path)


def champion_challenger(runs: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Latest version per model type; the best metric is champion; each
    other type in model-type order is assigned challenger in turn, so the last
    one keeps the alias (reference behaviour)."""
    m = runs.where(F.col("metric") == metric)
    latest = m.withColumn("__r", F.row_number().over(Window.partitionBy("model_type")
                                                      .orderBy(F.desc("version"), F.desc("run_id"))))
    latest = latest.where(F.col("__r") == 1).drop("__r")
    w = Window.orderBy(F.desc("value"), "model_type")  # one row per model type
    ranked = latest.withColumn("__pos", F.row_number().over(w))
    others = Window.partitionBy((F.col("__pos") == 1)).orderBy(F.desc("model_type"))
    ranked = ranked.withColumn("__last", F.row_number().over(others))
    alias = (F.when(F.col("__pos") == 1, "champion")
             .when((F.col("__pos") > 1) & (F.col("__last") == 1), "challenger"))
    return ranked.select("model_type", "version", "run_id", F.col("value").alias(metric), alias.alias("alias"))
