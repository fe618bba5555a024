"""Registered queries: evaluation metrics, model comparison, drift, monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import drift as D
from riskloom.operators import metrics as M
from riskloom.operators import risk as RK
from riskloom.plans import views as V
from riskloom.plans.queries_common import rounded
from riskloom.session import checkpoint_dir
from riskloom.sources.sinks import write_metrics

DRIFT_CUT = "2024-01-16"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return V.scored(spark, sf)


def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three competing scores on the labeled rows, long format (model, id, y, p):
    the toy score, the past-only merchant fraud rate, and a squashed amount."""
    t = RK.add_merchant_fraud_rate(V.tx(spark, sf))
    lab = t.where(F.col("has_label") & F.col("is_fraud").isNotNull())
    scores = {"toy_p": F.col("p"), "merchant_rate": F.col("merchant_historical_fraud_rate"),
              "amount_squash": F.col("amount") / (F.col("amount") + 100.0)}
    each = F.array(*[F.struct(F.lit(m).alias("model"), s.alias("p")) for m, s in scores.items()])
    return lab.select("id", F.col("is_fraud").alias("y"), F.explode(each).alias("s")).select("s.model", "id", "y", "s.p")


def metrics_long(scores: DataFrame) -> DataFrame:
    """(model, metric, value) - one row per model and metric."""
    return M.curve_metrics(scores, ["model"]).selectExpr(
        "model", "stack(5, 'pr_auc', pr_auc, 'roc_auc', roc_auc, 'brier', brier, "
        "'recall_at_precision_90', recall_at_precision, 'ks_stat', ks_stat) AS (metric, value)")


def q_eval_summary(spark, sf):
    return rounded(M.evaluate(_scored(spark, sf)))


def _one(metric: str):
    def q(spark, sf):
        return rounded(M.evaluate(_scored(spark, sf)).select(metric))
    return q


def q_confusion_matrix(spark, sf):
    s = _scored(spark, sf)
    out = M.confusion_matrix(s, 0.3)
    for t in (0.5, 0.7):
        out = out.unionByName(M.confusion_matrix(s, t))
    return rounded(out)


def q_ks_stat(spark, sf):
    return rounded(M.ks_statistic(_scored(spark, sf)).select("ks_stat", "ks_threshold"))


def q_ks_test(spark, sf):
    """M7 for each half of the ids: statistic, asymptotic p-value and threshold of a score that separates little."""
    s = _scored(spark, sf)
    weak = s.select("y", F.col("id"), (F.col("id") % 1000 / 1000.0).alias("p"))
    parts = [M.ks_statistic(weak.where(F.col("id") % 2 == h)).withColumn("half", F.lit(h)) for h in (0, 1)]
    return rounded(parts[0].unionByName(parts[1]))


def q_metrics_table(spark, sf):
    """The metrics as they are read back from the metrics table."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    write_metrics(metrics_long(candidate_scores(spark, sf)), path)
    return rounded(spark.read.parquet(path))


def q_lift_chart(spark, sf):
    return rounded(M.lift_table(_scored(spark, sf)))


def q_gain_chart(spark, sf):
    return rounded(M.gain_table(_scored(spark, sf)))


def q_calibration_curve(spark, sf):
    return rounded(M.calibration_curve(_scored(spark, sf)).drop("bin"))


def q_ece(spark, sf):
    return rounded(M.expected_calibration_error(_scored(spark, sf)))


def q_metrics_long(spark, sf):
    return rounded(metrics_long(candidate_scores(spark, sf)))


def q_model_leaderboard(spark, sf):
    return rounded(M.leaderboard(metrics_long(candidate_scores(spark, sf))))


def q_metric_winners(spark, sf):
    return rounded(M.metric_winners(metrics_long(candidate_scores(spark, sf))))


def q_performance_by_period(spark, sf):
    return rounded(D.performance_by_period(_scored(spark, sf), period="W"))


def _ref_cur(spark, sf):
    t = V.tx(spark, sf)
    cut = F.to_timestamp(F.lit(DRIFT_CUT))
    d = F.col("date").cast("timestamp")
    return t.where(d < cut), t.where(d >= cut)


def q_psi_numeric(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    return rounded(D.psi_numeric(ref, cur, ["amount", "p"]))


def q_psi_categorical(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    return rounded(D.psi_categorical(ref, cur, "mcc_str").unionByName(D.psi_categorical(ref, cur, "card_brand")))


def q_new_categories(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    return rounded(D.new_categories_share(ref, cur, "merchant_id")
                   .unionByName(D.new_categories_share(ref, cur, "mcc_str")))


def q_drift_report(spark, sf):
    ref, cur = _ref_cur(spark, sf)
    return rounded(D.compute_drift(ref, cur))


QUERIES = {
    "eval_summary": q_eval_summary, "pr_auc": _one("pr_auc"), "roc_auc": _one("roc_auc"), "brier": _one("brier"),
    "recall_at_precision": _one("recall_at_precision_90"), "confusion_matrix": q_confusion_matrix,
    "ks_stat": q_ks_stat, "lift_chart": q_lift_chart, "gain_chart": q_gain_chart,
    "calibration_curve": q_calibration_curve, "ece": q_ece, "metrics_long": q_metrics_long,
    "model_leaderboard": q_model_leaderboard, "metric_winners": q_metric_winners,
    "ks_test": q_ks_test, "metrics_table": q_metrics_table, "performance_by_period": q_performance_by_period, "psi_numeric": q_psi_numeric,
    "psi_categorical": q_psi_categorical, "new_categories": q_new_categories, "drift_report": q_drift_report,
}
