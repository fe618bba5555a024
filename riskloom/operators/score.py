"""Scoring: calibrated probability -> level, action, reason codes."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import ACTIONS, T_HIGH, T_MEDIUM
from riskloom.operators import explain as X
from riskloom.operators.features import prepare_matrix


def level_of(p: Column, t_high: float = T_HIGH, t_med: float = T_MEDIUM) -> Column:
    """P10: p >= 0.7 HIGH, p >= 0.3 MEDIUM, else LOW."""
    return F.when(p >= F.lit(t_high), "HIGH").when(p >= F.lit(t_med), "MEDIUM").otherwise("LOW")


def action_of(level: Column) -> Column:
    """Recommended action per level."""
    return (F.when(level == "HIGH", ACTIONS["HIGH"]).when(level == "MEDIUM", ACTIONS["MEDIUM"])
            .otherwise(ACTIONS["LOW"]))


def risk_level(df: DataFrame, p_col: str = "p", t_high: float = T_HIGH, t_med: float = T_MEDIUM) -> DataFrame:
    """risk_score (rounded to 6 dp as served), level, action."""
    p = F.col(p_col)
    return df.withColumn("risk_score", F.round(p, 6)).withColumn("level", level_of(p, t_high, t_med)) \
        .withColumn("action", action_of(F.col("level")))


def top_transactions(df: DataFrame, n: int, by: str = "amount", id_col: str = "id") -> DataFrame:
    """O2: the ``n`` rows with the largest ``by`` (NULLs last, ties by id): one
    TakeOrdered, so each task keeps at most ``n`` rows."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(id_col)).limit(n)


def predictions_preview(scored: DataFrame, n: int = 20, p_col: str = "p", id_col: str = "id", raw_col: str | None = None,
                        reasons: list[str] | None = None) -> DataFrame:
    """The ``n`` highest (calibrated) scores with level and action, the raw score and reason columns where given."""
    out = risk_level(scored, p_col)
    raw = [F.round(raw_col, 6).alias("raw_score")] if raw_col else []
    return top_transactions(out.select(id_col, *raw, "risk_score", "level", "action", *(reasons or [])), n, "risk_score", id_col)


def score_split(rows: DataFrame, model, calibrator, features: list[str], cats: list[str], base: dict, *, id_col: str = "id",
                error: str | None = None, k: int = 3) -> DataFrame:
    """Every row of ``rows`` once, labelled or not: id, risk_score, level, the ``k`` strongest reasons
    (feature, impact on the margin, value) and ``error``.

    Rows whose ``error`` column is not NULL are not scored; they keep their error.
    Scores are calibrated; reasons explain the margin of the model that scores.
    """
    why = F.col(error) if error else F.lit(None).cast("string")
    good = prepare_matrix(rows.where(why.isNull()), features, cats, keep=[id_col])
    explained = X.shapley_contributions(good, features, base, X.margin_of(model), keep=[id_col], id_col=id_col)
    calibrated = calibrator.transform(explained.withColumn("proba", F.lit(1.0) / (1 + F.exp(F.lit(-model_scale(model)) * F.col("margin")))))
    out = X.widen_reasons(X.reason_codes(risk_level(calibrated, "proba_cal"), k=k), k=k)
    reasons = [f"reason_{j + 1}_{part}" for j in range(k) for part in ("feature", "impact", "value")]
    scored = out.select(id_col, "risk_score", "level", *reasons, F.lit(None).cast("string").alias("error"))
    if not error:
        return scored
    bad = rows.where(why.isNotNull()).select(F.col(id_col), F.col(error).cast("string").alias("error"))
    return scored.unionByName(bad, allowMissingColumns=True)


def model_scale(model) -> float:
    """What the margin is multiplied by in the logistic function: 2 for boosted trees, 1 otherwise."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model.model
    return 2.0 if isinstance(last, GBTClassificationModel) else 1.0
