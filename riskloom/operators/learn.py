"""Model training, tuning and calibration on Spark ML.

The reference's native boosters are re-aimed to ``pyspark.ml``:
CatBoost -> GBTClassifier (categoricals via StringIndexer), XGBoost with
target encoding -> TargetEncoder + GBTClassifier, LightGBM -> RandomForest.
Every model turns prepared rows into a ``proba`` column: a ``PipelineModel``, or
a ``BoostedPrefix`` (the rounds of a boosted model with the best PR-AUC on
validation rows), alone or behind out-of-fold target encoding.
Training reads labeled rows only; fitting runs on executors (tree
aggregation), nothing is collected but the model itself.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from riskloom.functions.scalar import clip_prob
from riskloom.operators.features import prepare_matrix, target_encode_apply, target_encode_fit, target_encode_oof
from riskloom.operators.isotonic import apply_isotonic, fit_isotonic
from riskloom.operators.metrics import curve_metrics, evaluate
from riskloom.operators.runs import RUNS_SCHEMA, append_runs, log_run
from riskloom.session import materialize


@dataclass
class TreeParams:
    max_iter: int = 50
    max_depth: int = 6
    step_size: float = 0.05
    max_bins: int = 64
    subsampling_rate: float = 1.0
    min_instances_per_node: int = 1
    min_info_gain: float = 0.0
    scale_pos_weight: float = 1.0
    seed: int = 42
    extra: dict = field(default_factory=dict)


def labeled(df: DataFrame, label: str = "is_fraud", has_label: str = "has_label") -> DataFrame:
    """Labeled rows with a target."""
    out = df.where(F.col(has_label)) if has_label in df.columns else df
    return out.where(F.col(label).isNotNull())


# -- boosted models and their prefixes ------------------------------------------

def _leaf_values(tree) -> list[float]:
    """The predictions of a tree's leaves from left to right, the order of their indices."""
    return [float(line.split("Predict:")[1]) for line in tree.toDebugString.splitlines() if "Predict:" in line]


def _tree_columns(model: GBTClassificationModel, df: DataFrame, rounds: int) -> DataFrame:
    """``df`` with ``__steps``: what each of the first ``rounds`` trees adds to the margin, in one pass.

    One call of the model gives a row's leaves in all trees; what a leaf adds is looked up by its index.
    A few of many trees are called one by one.
    """
    if rounds * 8 <= model.getNumTrees:
        few = list(zip(model.trees[:rounds], model.treeWeights))
        for k, (tree, _) in enumerate(few):
            df = tree.transform(df, {tree.predictionCol: f"__t{k}"})
        names = [f"__t{k}" for k in range(len(few))]
        return df.withColumn("__steps", F.array(*[F.col(n) * F.lit(float(w)) for n, (_, w) in zip(names, few)])).drop(*names)
    df = model.transform(df, {model.leafCol: "__leaves", model.rawPredictionCol: "", model.probabilityCol: "", model.predictionCol: ""})
    df = df.withColumn("__leaves", vector_to_array("__leaves"))
    steps = []
    for k, (tree, weight) in enumerate(zip(model.trees[:rounds], model.treeWeights)):
        adds = F.expr(f"array({', '.join(f'{v * weight!r}D' for v in _leaf_values(tree))})")
        steps.append(F.get(adds, F.get("__leaves", F.lit(k)).cast("int")))
    return df.withColumn("__steps", F.array(*steps)).drop("__leaves")


def _probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def prefix_metrics(model: GBTClassificationModel, matrix: DataFrame, label: str) -> DataFrame:
    """(rounds, pr_auc) of every prefix of a boosted model on the rows of ``matrix`` (features, label).

    One scoring pass gives each row the margins after 1, 2, ... rounds; one
    distinct-score table keyed by the prefix gives all curves.
    """
    @F.pandas_udf("array<double>")
    def margins(steps: pd.Series) -> pd.Series:
        return pd.Series([*np.cumsum(np.vstack(steps), axis=1)] if len(steps) else [])

    scored = _tree_columns(model, matrix, len(model.treeWeights)).select(
        F.col(label).cast("int").alias("y"), margins("__steps").alias("m")).select("y", F.posexplode("m").alias("k", "m"))
    scored = scored.select((F.col("k") + 1).alias("rounds"), "y", _probability(F.col("m")).alias("p"))
    return curve_metrics(scored, ["rounds"]).select("rounds", "pr_auc")


@dataclass
class BoostedPrefix:
    """Feature stages, a boosted model and the number of its first rounds that count.

    ``history``: PR-AUC on the validation rows after each round; ``rounds`` is the
    first of the best (all rounds where the validation rows have no positive).
    """

    stages: PipelineModel
    model: GBTClassificationModel
    rounds: int
    history: list[tuple[int, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with features, margin and proba."""
        out = _tree_columns(self.model, self.stages.transform(df), self.rounds)
        margin = F.aggregate("__steps", F.lit(0.0), lambda acc, x: acc + x)
        return out.withColumn("margin", margin).withColumn("proba", _probability(F.col("margin"))).drop("__steps")


@dataclass
class TargetEncoded:
    """A model over target-encoded categoricals; ``encoders``: the encodings of all training rows (a written table)."""

    encoders: DataFrame
    cats: list[str]
    model: BoostedPrefix | PipelineModel

    def encode(self, df: DataFrame) -> DataFrame:
        return target_encode_apply(df, self.encoders, self.cats)


Model = PipelineModel | BoostedPrefix | TargetEncoded


def best_prefix(model: GBTClassificationModel, matrix: DataFrame, label: str) -> tuple[int, list[tuple[int, float | None]]]:
    """(rounds, history): the number of rounds with the greatest PR-AUC on ``matrix``, the smallest on ties."""
    history = sorted((r["rounds"], r["pr_auc"]) for r in prefix_metrics(model, matrix, label).collect())   # a row for each round
    known = [(-v, k) for k, v in history if v is not None]
    return (min(known)[1] if known else len(model.treeWeights)), history


def _stages_for(features: list[str], cats: list[str]) -> list:
    stages, inputs = [], [c for c in features if c not in cats]
    if cats:
        idx = [f"{c}__idx" for c in cats]
        stages.append(StringIndexer(inputCols=cats, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"))
        inputs += idx
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def _bins(train: DataFrame, cats: list[str], max_bins: int) -> int:
    """``max_bins``, or a bin for each category and one for unseen ones."""
    if not cats:
        return max_bins
    most = train.agg(F.greatest(*[F.count_distinct(c) for c in cats], F.lit(0)).alias("n")).first()["n"]
    return max(max_bins, int(most) + 1)


def _boosting(params: TreeParams, label: str, max_bins: int, weight_col: str | None) -> GBTClassifier:
    clf = GBTClassifier(labelCol=label, featuresCol="features", maxIter=params.max_iter, maxDepth=params.max_depth,
                        stepSize=params.step_size, maxBins=max_bins, subsamplingRate=params.subsampling_rate,
                        minInstancesPerNode=params.min_instances_per_node, minInfoGain=params.min_info_gain, seed=params.seed)
    return clf.setWeightCol(weight_col) if weight_col else clf


def _weighted(df: DataFrame, label: str, params: TreeParams, weight_col: str | None) -> tuple[DataFrame, str | None]:
    """``df`` with the weight a fit uses: ``weight_col``, times ``scale_pos_weight`` for positives."""
    if params.scale_pos_weight == 1.0:
        return df, weight_col
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    return df.withColumn("__w", w * F.when(F.col(label) == 1, F.lit(float(params.scale_pos_weight))).otherwise(F.lit(1.0))), "__w"


def concurrently(spark: SparkSession, run: Callable, items: Iterable, parallelism: int = 4) -> Iterator[tuple]:
    """(item, future of run(item)) as they finish: fits are many small jobs, which share the cluster."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        inherited = inheritable_thread_target(spark)(run)
        of = {pool.submit(inherited, x): x for x in items}
        for done in as_completed(of):
            yield of[done], done


def fit_classifier(train: DataFrame, features: list[str], cats: list[str], *, kind: str = "gbt",
                   label: str = "is_fraud", val: DataFrame | None = None, params: TreeParams | None = None,
                   weight_col: str | None = None, id_col: str = "id") -> Model:
    """L1/L2/L3.  ``kind``: gbt (index-encoded categoricals), gbt_te (target
    encoded out of fold, by ``id_col``), rf (random forest), lr (logistic
    regression).  With ``val`` a boosted model keeps the rounds with the best
    PR-AUC on those rows."""
    params = params or TreeParams()
    if kind == "gbt_te":
        encoders = materialize(target_encode_fit(train, cats, label), "target-encoders")
        encoded = target_encode_oof(train, cats, label, id_col, suffix="")
        model = fit_classifier(encoded, features, [], kind="gbt", label=label, params=params, weight_col=weight_col, id_col=id_col,
                               val=target_encode_apply(val, encoders, cats) if val is not None else None)
        return TargetEncoded(encoders, cats, model)
    train, weight_col = _weighted(train, label, params, weight_col)
    keep = [label] + ([weight_col] if weight_col else [])
    tr = prepare_matrix(train, features, cats, keep=keep).withColumn(label, F.col(label).cast("double"))
    stages = _stages_for(features, cats)
    if kind == "gbt":
        clf = _boosting(params, label, _bins(tr, cats, params.max_bins), weight_col)
        if val is None:
            return Pipeline(stages=[*stages, clf]).fit(tr)
        prepared = Pipeline(stages=stages).fit(tr)
        model = clf.fit(prepared.transform(tr))
        rounds, history = best_prefix(model, prepared.transform(prepare_matrix(val, features, cats, keep=[label])), label)
        return BoostedPrefix(prepared, model, rounds, history)
    if kind == "rf":
        clf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=max(10, params.max_iter),
                                     maxDepth=params.max_depth, maxBins=_bins(tr, cats, params.max_bins), seed=params.seed,
                                     subsamplingRate=params.subsampling_rate)
    elif kind == "lr":
        clf = LogisticRegression(labelCol=label, featuresCol="features", maxIter=100)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    if weight_col:
        clf = clf.setWeightCol(weight_col)
    return Pipeline(stages=[*stages, clf]).fit(tr)


def predict_proba(model: Model, df: DataFrame, features: list[str], cats: list[str],
                  keep: list[str], out: str = "proba") -> DataFrame:
    """Score rows: positive-class probability in ``out``; ``keep`` columns pass through."""
    if isinstance(model, TargetEncoded):
        hold = {c: f"__keep_{c}" for c in keep if c in model.cats}
        encoded = model.encode(df.withColumns({v: F.col(c) for c, v in hold.items()}) if hold else df)
        scored = predict_proba(model.model, encoded, features, [], [hold.get(c, c) for c in keep], out)
        return scored.withColumnsRenamed({v: c for c, v in hold.items()})
    scored = model.transform(prepare_matrix(df, features, cats, keep=keep))
    proba = F.col("proba") if isinstance(model, BoostedPrefix) else vector_to_array("probability")[1]
    return scored.select(*keep, proba.alias(out))


def class_weight(train: DataFrame, label: str = "is_fraud") -> float:
    """L4: scale_pos_weight = negatives / positives (a scalar aggregate)."""
    r = train.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return float(r["neg"]) / float(r["pos"]) if r["pos"] else 1.0


# -- calibration (L7, L8) -----------------------------------------------------

@dataclass
class Calibrator:
    method: str
    model: object

    def transform(self, df: DataFrame, p: str = "proba", out: str = "proba_cal") -> DataFrame:
        """``out`` = the calibrated score, clipped to [1e-6, 1 - 1e-6]."""
        if self.method == "isotonic":
            return apply_isotonic(df, self.model, p, out).withColumn(out, clip_prob(F.col(out)))
        v = VectorAssembler(inputCols=[p], outputCol="__v").transform(df)
        res = self.model.transform(v)
        return res.withColumn(out, clip_prob(vector_to_array("probability")[1])) \
            .drop("__v", "rawPrediction", "probability", "prediction")


def fit_calibrator(df: DataFrame, p: str = "proba", y: str = "y", method: str = "isotonic") -> Calibrator:
    """Isotonic (default; the model is the table of pools) or Platt (1-feature
    logistic regression, C=1 -> regParam = 1/n without standardization)."""
    if method == "isotonic":
        return Calibrator("isotonic", fit_isotonic(df, p, y))
    if method in ("platt", "sigmoid"):
        n = df.count()
        v = VectorAssembler(inputCols=[p], outputCol="__v").transform(df.select(p, F.col(y).cast("double").alias("__y")))
        lr = LogisticRegression(featuresCol="__v", labelCol="__y", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                                standardization=False, maxIter=100)
        return Calibrator("platt", lr.fit(v))
    raise ValueError(f"unknown calibration method {method!r}")


# -- tuning and benchmark (L5, L6) ---------------------------------------------

def sample_params(space: dict, rng: random.Random) -> dict:
    """One draw: (lo, hi, 'log'|'lin'|'int') tuples or lists of choices."""
    out = {}
    for k, spec in space.items():
        if isinstance(spec, list):
            out[k] = rng.choice(spec)
        else:
            lo, hi, kind = spec
            if kind == "log":
                out[k] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            elif kind == "int":
                out[k] = rng.randint(lo, hi)
            else:
                out[k] = rng.uniform(lo, hi)
    return out


GBT_SPACE = {"max_depth": (3, 8, "int"), "step_size": (0.01, 0.3, "log"), "max_iter": (20, 80, "int"),
             "subsampling_rate": (0.6, 1.0, "lin"), "min_instances_per_node": (1, 20, "int"), "min_info_gain": (0.0, 0.01, "lin"),
             "max_bins": (32, 255, "int"), "scale_pos_weight": (1.0, 50.0, "log")}

#: Shares of a candidate's rounds that the rungs of a search give, and of the candidates that go on to the next.
RUNGS = (0.125, 0.5, 1.0)
KEEP = 0.4


def run_tuning(train: DataFrame, val: DataFrame, features: list[str], cats: list[str], *, label: str = "is_fraud",
               n_trials: int = 10, seed: int = 42, space: dict | None = None, rungs: tuple[float, ...] = RUNGS,
               keep: float = KEEP, parallelism: int = 4) -> DataFrame:
    """Seeded random search for the greatest validation PR-AUC by successive halving.

    The feature matrices are prepared and written once, and every fit reads them
    whole: rungs differ in boosting rounds, not in rows.  A rung fits its
    candidates concurrently (their small jobs share the cluster) and judges each
    by its best prefix; ``keep`` of them go on with more rounds.
    Returns (trial, rung, rounds, params, pr_auc), the last rung each candidate
    reached, best first.
    """
    spark = train.sparkSession
    rng = random.Random(seed)
    tr = prepare_matrix(train, features, cats, keep=[label]).withColumn(label, F.col(label).cast("double"))
    prepared = Pipeline(stages=_stages_for(features, cats)).fit(tr)
    categories = _bins(tr, cats, 0)
    names = [label, "features"]
    matrix = materialize(prepared.transform(tr).select(*names), "tuning-train").persist()
    judge = materialize(prepared.transform(prepare_matrix(val, features, cats, keep=[label])).select(*names), "tuning-val").persist()

    def trial(rung: int, number: int, params: TreeParams) -> tuple[float, int]:
        fewer = replace(params, max_iter=max(2, math.ceil(params.max_iter * rungs[rung])))
        rows, weight = _weighted(matrix, label, fewer, None)
        model = _boosting(fewer, label, max(fewer.max_bins, categories), weight).fit(rows)
        rounds, history = best_prefix(model, judge, label)
        return dict(history).get(rounds), rounds

    drawn = {t: sample_params(space or GBT_SPACE, rng) for t in range(n_trials)}
    found: dict[int, tuple] = {}
    alive = list(drawn)
    try:
        for rung in range(len(rungs)):
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                run = inheritable_thread_target(spark)(
                    lambda t, rung=rung: trial(rung, t, TreeParams(**{k: v for k, v in drawn[t].items() if k in TreeParams.__dataclass_fields__})))
                for t, (ap, rounds) in zip(alive, pool.map(run, alive)):
                    found[t] = (t, rung, rounds, str(sorted(drawn[t].items())), ap)
            order = sorted(alive, key=lambda t: (-(found[t][4] if found[t][4] is not None else -1.0), t))
            alive = sorted(order[:max(1, math.ceil(keep * len(order)))])
    finally:
        matrix.unpersist()
        judge.unpersist()
    return spark.createDataFrame(list(found.values()), "trial int, rung int, rounds int, params string, pr_auc double") \
        .orderBy(F.desc("rung"), F.desc("pr_auc"), "trial")


METRICS = ("pr_auc", "roc_auc", "brier", "recall_at_precision_90")


def run_benchmark(train: DataFrame, val: DataFrame, features: list[str], cats: list[str],
                  kinds=("gbt", "gbt_te", "rf"), label: str = "is_fraud", params: TreeParams | None = None,
                  id_col: str = "id", log: str | None = None) -> DataFrame:
    """Fit several model kinds concurrently and evaluate each on the validation
    rows; one (model, metric, value) table.  With ``log`` (a folder) each model's
    metrics are appended to the run log there as soon as it is evaluated, so a
    benchmark that stops half way keeps what it found."""
    spark = train.sparkSession

    def judged(k: str) -> dict:
        m = fit_classifier(train, features, cats, kind=k, label=label, params=params, val=val if k.startswith("gbt") else None, id_col=id_col)
        sc = predict_proba(m, val, features, cats, keep=[id_col, label])
        ev = evaluate(sc.select(F.col(label).alias("y"), F.col("proba").alias("p"))).first()
        return {name: ev[name] for name in METRICS}

    found: dict[str, dict] = {}
    lost = []
    for k, done in concurrently(spark, judged, kinds):
        if done.exception():
            lost.append(done.exception())       # raised when the others are in the log
            continue
        found[k] = done.result()
        if log:
            append_runs(log_run(spark, f"{k}-1", k, 1, found[k]), log)  # one at a time: they go to one folder
    if lost:
        raise lost[0]
    rows = [(k, name, None if v is None else float(v)) for k in kinds for name, v in found[k].items()]
    return spark.createDataFrame(rows, "model string, metric string, value double")


__all__ = ["RUNS_SCHEMA", "BoostedPrefix", "Calibrator", "TargetEncoded", "TreeParams", "best_prefix", "class_weight", "concurrently", "fit_calibrator",
           "fit_classifier", "labeled", "predict_proba", "prefix_metrics", "run_benchmark", "run_tuning", "sample_params"]
