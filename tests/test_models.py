import math
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features as FE
from riskloom.operators import learn as L
from riskloom.operators import select as SE


def test_feature_detection(tiny_transactions):
    feats, cats = FE.get_feature_columns(tiny_transactions)
    for c in ("id", "date", "is_fraud", "has_label"):
        assert c not in feats
    assert "amount" in feats and "credit_limit" in feats
    assert "merchant_id" in cats and "mcc_str" in cats


def test_target_encoding_formula(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), (None, 1)], "c string, y int")
    enc = {(r.feature, r.category): r.encoding for r in FE.target_encode_fit(df, ["c"], "y", smoothing=100).collect()}
    g = 0.5
    assert enc[("c", "a")] == pytest.approx((2 * 0.5 + 100 * g) / 102)
    assert enc[("c", "__missing__")] == pytest.approx((1 * 1 + 100 * g) / 101)
    out = FE.target_encode_apply(spark.createDataFrame([("zzz",)], "c string"), FE.target_encode_fit(df, ["c"], "y"), ["c"])
    assert out.first().c == pytest.approx(g)


def test_calibrators(spark):
    y = [0] * 5 + [1] * 5
    p = [0.1, 0.2, 0.15, 0.3, 0.05, 0.7, 0.8, 0.9, 0.6, 0.85]
    df = spark.createDataFrame(list(zip(y, p)), "y int, proba double")
    for method in ("isotonic", "platt"):
        cal = L.fit_calibrator(df, "proba", "y", method)
        out = [r.proba_cal for r in cal.transform(df).collect()]
        assert all(1e-6 <= v <= 1 - 1e-6 for v in out)
    with pytest.raises(ValueError):
        L.fit_calibrator(df, "proba", "y", "unknown")


def test_gbt_beats_base_rate(spark, tiny_transactions):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("is_fraud"),
                                 (F.col("id") % 7).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    m = L.fit_classifier(df, ["x", "c"], ["c"], kind="gbt", params=L.TreeParams(max_iter=5, max_depth=3))
    sc = L.predict_proba(m, df, ["x", "c"], ["c"], keep=["id", "is_fraud"])
    from riskloom.operators.metrics import evaluate
    ap = evaluate(sc.select(F.col("is_fraud").alias("y"), F.col("proba").alias("p"))).first().pr_auc
    assert ap > 0.5


def test_vif_drops_collinear(spark):
    df = spark.range(200).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0 + 1).alias("b"),
                                 (F.col("id") % 13 * 1.0).alias("c"))
    kept, dropped = SE.vif_filter(df, ["a", "b", "c"], 10.0)
    assert len(dropped) >= 1 and "c" in kept
    k2, d2 = SE.correlation_filter(df, ["a", "b", "c"], 0.95)
    assert k2 == ["a", "c"] and d2 == ["b"]


def test_verify_saved_model_one_row(spark):
    """A persisted PipelineModel reloads and scores a single row."""
    import tempfile

    from pyspark.ml import PipelineModel
    df = spark.range(200).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("is_fraud"),
                                 (F.col("id") % 5).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    m = L.fit_classifier(df, ["x", "c"], ["c"], kind="gbt", params=L.TreeParams(max_iter=3, max_depth=2))
    path = tempfile.mkdtemp(prefix="riskloom-model-") + "/m"
    m.write().overwrite().save(path)
    again = PipelineModel.load(path)
    one = L.predict_proba(again, df.limit(1), ["x", "c"], ["c"], keep=["id"]).first()
    assert 0.0 <= one.proba <= 1.0


def test_permuted_rows_ignore_partitions_and_are_permutations(spark):
    df = spark.range(500).selectExpr("id", "id * 3 AS v", "concat('s', id) AS w", "cast(id % 2 AS int) AS is_fraud")
    rows = [sorted(map(tuple, SE.permuted_rows(df.repartition(n), ["v", "w"], "is_fraud", 2, 5, "id").collect())) for n in (1, 13)]
    assert rows[0] == rows[1] and len(rows[0]) == 5 * 500
    plain = {(r[3], r[4]) for r in rows[0] if r[0] == -1}
    moved = [sorted(r[3 + f] for r in rows[0] if (r[0], r[1]) == (f, k)) for f in (0, 1) for k in (0, 1)]
    assert all(m == sorted(x[i // 2] for x in plain) for i, m in enumerate(moved))
    for f in (0, 1):
        for k in (0, 1):
            part = [r for r in rows[0] if (r[0], r[1]) == (f, k)]
            assert sum((r[3], r[4]) in plain for r in part) == 0            # no row keeps its own value
            assert sorted(r[4 - f] for r in part) == sorted(x[1 - f] for x in plain)


def test_permuted_rows_are_not_broadcast(spark):
    """The ranked rows are data: however small their file, the join by rank sorts both sides."""
    df = spark.range(200).selectExpr("id", "id * 3 AS v", "cast(id % 2 AS int) AS is_fraud")
    rows = SE.permuted_rows(df, ["v"], "is_fraud", 2, 5, "id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert rows.count() == 3 * 200


def test_permutation_keeps_columns_that_are_not_permuted(spark):
    """A scorer of x and z, of which only x is judged (the filters before dropped z)."""
    df = spark.range(300).selectExpr("id", "cast(id % 4 = 0 AS int) AS is_fraud", "cast(id % 4 AS double) AS x", "id * 1.0D AS z")
    m = L.fit_classifier(df, ["x", "z"], [], kind="lr")
    got = SE.permutation_importance(lambda d, keep: L.predict_proba(m, d, ["x", "z"], [], keep=keep), df, ["x"], n_repeats=2).first()
    assert got.feature == "x" and got.importance > 0.3


def test_permutation_importance_finds_the_feature_that_matters(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 4 = 0 AS int) AS is_fraud", "cast(id % 4 AS double) AS x", "cast(id % 9 AS double) AS z",
                                     "concat('c', id % 3) AS c")
    jobs = []
    got = {r.feature: r for r in SE.permutation_importance(
        lambda d, keep: jobs.append(1) or d.select(*keep, (F.lit(1.0) / (1 + F.col("x")) + F.col("z") * 1e-6).alias("proba")),
        df, ["x", "z", "c"], n_repeats=3).collect()}
    assert got["x"].importance > 0.5 and abs(got["z"].importance) < 0.05 and got["c"].importance == 0.0 and got["c"].std == 0.0
    assert len(jobs) == 1                            # all permutations are scored together


def test_trees_take_more_categories_than_bins(spark):
    from riskloom.operators import learn as L
    rows = [(i, float(i % 13), f"c{i % 109}", float(i % 109 < 20)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, x double, cat string, is_fraud double")
    for kind in ("gbt", "rf"):
        m = L.fit_classifier(df, ["x", "cat"], ["cat"], kind=kind, params=L.TreeParams(max_iter=2, max_depth=2))
        assert L.predict_proba(m, df, ["x", "cat"], ["cat"], keep=["id"]).count() == 1500


def test_select_features_uses_the_operators_repeats(spark, monkeypatch):
    from riskloom.plans import q_ml
    seen = []
    real = SE.permuted_rows
    monkeypatch.setattr(SE, "correlation_filter", lambda df, feats, t: (feats[:2], []))
    monkeypatch.setattr(SE, "vif_filter", lambda df, feats, t: (feats, []))
    monkeypatch.setattr(SE, "permuted_rows", lambda df, feats, label, n, seed, id_col: seen.append((len(feats), n)) or real(df, feats, label, n, seed, id_col))
    monkeypatch.setattr(q_ml, "_fitted_scorer", lambda lab, feats: lambda d, keep: d.select(*keep, F.lit(0.5).alias("proba")))
    assert q_ml.q_select_features(spark, "/root/testdata/sf0.001").count()
    assert seen == [(2, 5)]


def test_vif_says_when_it_cannot_judge(spark):
    with pytest.warns(UserWarning, match="VIF filter skipped: 3 complete rows"):
        assert SE.vif_filter(spark.range(3).selectExpr("id * 1.0 AS a", "id * 2.0 AS b"), ["a", "b"]) == (["a", "b"], [])


@pytest.mark.parametrize("name", ["train_gbt", "train_gbt_te", "train_rf", "train_prefix", "train_checks", "calibrate_isotonic_gbt",
                                  "calibrate_platt", "benchmark", "tune", "score_batch"])
def test_registered_queries_train_whole_models(spark, monkeypatch, name):
    from riskloom.plans import q_ml

    class Seen(Exception):
        pass

    def fit(*args, params=None, **kw):
        raise Seen(params or L.TreeParams())

    def tune(*args, n_trials=5, space=None, **kw):
        raise Seen((n_trials, space or L.GBT_SPACE))
    empty = spark.createDataFrame([], "id long, is_fraud int, has_label boolean, split string")
    monkeypatch.setattr(q_ml, "_frame", lambda spark, sf: empty)
    monkeypatch.setattr(L, "fit_classifier", fit)
    monkeypatch.setattr(L, "run_tuning", tune)
    with pytest.raises(Seen) as e:
        q_ml.QUERIES[name](spark, "/root/testdata/sf0.001")
    if name == "tune":
        assert e.value.args[0][0] >= 10 and e.value.args[0][1] == L.GBT_SPACE
    else:
        assert e.value.args[0] == L.TreeParams()


def _small(spark, n=600):
    return spark.range(n).select("id", ((F.col("id") % 7 == 0) | (F.col("id") % 11 == 3)).cast("int").alias("is_fraud"),
                                 (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"),
                                 F.concat(F.lit("c"), F.col("id") % 11).alias("c"))


def average_precision(rows):
    """Step sum over distinct scores; rows of (y, p)."""
    total, out, tp, n = sum(y for y, _ in rows), 0.0, 0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        here = [y for y, p in rows if p == s]
        tp, n = tp + sum(here), n + len(here)
        out += sum(here) / total * tp / n
    return out


def test_boosted_prefix_is_the_best_of_all_prefixes(spark):
    df = _small(spark).withColumn("is_fraud", F.when(F.col("id") % 13 == 0, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    tr, va = df.where("id < 350"), df.where("id >= 350")
    m = L.fit_classifier(tr, ["x", "z", "c"], ["c"], kind="gbt", val=va, params=L.TreeParams(max_iter=6, max_depth=3))
    matrix = m.stages.transform(FE.prepare_matrix(va, ["x", "z", "c"], ["c"], keep=["is_fraud"])).select("is_fraud", "features").collect()
    want = []
    for k in range(1, 7):
        margins = [sum(w * t.predict(r.features) for t, w in zip(m.model.trees[:k], m.model.treeWeights)) for r in matrix]
        want.append(average_precision([(r.is_fraud, round(v, 12)) for r, v in zip(matrix, margins)]))
    assert [k for k, _ in m.history] == [1, 2, 3, 4, 5, 6]
    assert [v for _, v in m.history] == pytest.approx(want, abs=1e-9)
    assert want[m.rounds - 1] == pytest.approx(max(want), abs=1e-9)
    # All rounds: what Spark's own model says.
    m.rounds = 6
    own = {r.id: r.proba for r in L.predict_proba(m, va, ["x", "z", "c"], ["c"], keep=["id"]).collect()}
    from pyspark.ml.functions import vector_to_array
    spark_says = m.model.transform(m.stages.transform(FE.prepare_matrix(va, ["x", "z", "c"], ["c"], keep=["id"])))
    for r in spark_says.select("id", vector_to_array("probability")[1].alias("p")).collect():
        assert own[r.id] == pytest.approx(r.p)


def test_out_of_fold_encoding_never_sees_the_own_label(spark):
    rows = [(k, f"c{k % 5}" if k % 9 else None, int(k % 3 == 0)) for k in range(200)] + [(900, "unique", 1), (901, "c1", None)]
    df = spark.createDataFrame(rows, "id long, c string, y int").repartition(3)
    fold = {r.id: r.f for r in df.select("id", FE.fold_of("id", 5).alias("f")).collect()}
    got = {r.id: r.c_te for r in FE.target_encode_oof(df, ["c"], "y", smoothing=10).collect()}
    assert set(fold.values()) == {0, 1, 2, 3, 4} and len(got) == len(rows)
    for i, c, _ in rows:
        others = [(d, y) for j, d, y in rows if fold[j] != fold[i] and y is not None]
        prior = sum(y for _, y in others) / len(others)
        same = [y for d, y in others if d == c]
        assert got[i] == pytest.approx((sum(same) + 10 * prior) / (len(same) + 10)), i
    # Turning a row's own label leaves its encoding as it was.
    other = spark.createDataFrame([(i, c, 1 - y if i == 7 else y) for i, c, y in rows], "id long, c string, y int")
    again = {r.id: r.c_te for r in FE.target_encode_oof(other, ["c"], "y", smoothing=10).collect()}
    assert again[7] == got[7] and again != got
    m = L.fit_classifier(df.where("y is not null").withColumnRenamed("y", "is_fraud"), ["c"], ["c"], kind="gbt_te", params=L.TreeParams(max_iter=2, max_depth=2))
    assert L.predict_proba(m, df, ["c"], ["c"], keep=["id", "c"]).where("proba > 0").count() == len(rows)


def brute_isotonic(rows):
    """Value at each distinct score by the max-min formula."""
    xs = sorted({p for p, _ in rows})
    ys = [[y for p, y in rows if p == x] for x in xs]
    mean = lambda a, b: sum(sum(v) for v in ys[a:b + 1]) / sum(len(v) for v in ys[a:b + 1])               # noqa: E731
    return xs, [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]


@pytest.mark.parametrize("rows_a_task", [500_000, 7])
def test_isotonic_equals_max_min(spark, monkeypatch, rows_a_task):
    import bisect
    import random

    from riskloom.operators import isotonic as I
    monkeypatch.setattr(I, "POOL_ROWS", rows_a_task)
    rng = random.Random(3)
    for shape in (lambda p: p, lambda p: 1 - p, lambda p: 0.5):
        rows = [(round(rng.random(), 2), int(rng.random() < shape(rng.random()))) for _ in range(150)]
        rows = [(p, int(rng.random() < shape(p))) for p, _ in rows]
        df = spark.createDataFrame(rows + [(None, 1), (0.3, None)], "proba double, y int")
        pools = I.fit_isotonic(df)
        xs, want = brute_isotonic(rows)
        asked = sorted({*xs, -1.0, 2.0, *[round(rng.random(), 4) for _ in range(60)]})
        test = spark.createDataFrame([(x,) for x in asked] + [(None,)], "proba double")
        got = {r.proba: r.proba_cal for r in I.apply_isotonic(test, pools).collect()}
        assert got.pop(None) is None
        for x in asked:
            k = bisect.bisect_right(xs, x) - 1
            if k < 0 or k + 1 == len(xs) or xs[k] == x:
                exp = want[max(k, 0)]
            else:
                exp = want[k] + (want[k + 1] - want[k]) * (x - xs[k]) / (xs[k + 1] - xs[k])
            assert got[x] == pytest.approx(exp), x
    none = I.fit_isotonic(df.limit(0))
    assert none.count() == 0 and I.apply_isotonic(test, none).where("proba_cal is not null").count() == 0


def test_tuning_halves_and_judges_by_best_prefix(spark):
    df = _small(spark, 300)
    space = {"max_depth": (2, 3, "int"), "max_iter": (8, 16, "int"), "step_size": [0.1, 0.3], "scale_pos_weight": [1.0, 5.0]}
    out = L.run_tuning(df.where("id < 200"), df.where("id >= 200"), ["x", "z", "c"], ["c"], n_trials=5, space=space, parallelism=2).collect()
    assert sorted(r.trial for r in out) == list(range(5)) and [r.rung for r in out] == [2, 1, 0, 0, 0]
    assert all(0 <= r.pr_auc <= 1 and 1 <= r.rounds <= 16 for r in out) and "scale_pos_weight" in out[0].params


def test_benchmark_logs_each_model_as_it_finishes(spark, tmp_path, monkeypatch):
    from riskloom.operators import runs
    df = _small(spark, 200)
    real, done = L.fit_classifier, []

    def fit(*a, kind, **k):
        if kind == "rf":
            raise RuntimeError("lost")
        done.append(kind)
        return real(*a, kind=kind, **k)
    monkeypatch.setattr(L, "fit_classifier", fit)
    with pytest.raises(RuntimeError):
        L.run_benchmark(df, df, ["x", "z"], [], kinds=("lr", "rf"), log=f"{tmp_path}/runs")
    log = spark.read.schema(runs.RUNS_SCHEMA).parquet(f"{tmp_path}/runs").collect()
    assert done == ["lr"] and {r.metric for r in log} == set(L.METRICS) and {r.model_type for r in log} == {"lr"}
    assert runs.log_run(spark, "r", "m", 1, {"a": float("nan"), "b": None, "c": 1.0}).count() == 1


def test_shapley_contributions_add_up_and_equal_exact_values(spark):
    import itertools
    import math

    from riskloom.operators import explain as X
    feats = ["x", "z", "c"]
    df = _small(spark)
    m = L.fit_classifier(df.where("id < 400"), feats, ["c"], kind="gbt", val=df.where("id >= 400"), params=L.TreeParams(max_iter=4, max_depth=3))
    base = X.base_row(df, feats, ["c"])
    rows = FE.prepare_matrix(df.where("id < 40"), feats, ["c"], keep=["id"])
    got = X.shapley_contributions(rows, feats, base, X.margin_of(m), keep=["id"], orders=3).collect()
    assert len(got) == 40
    want = {r.id: r.proba for r in L.predict_proba(m, df.where("id < 40"), feats, ["c"], keep=["id"]).collect()}
    values = {}
    for r in rows.collect():
        for mask in range(8):
            values[r.id, mask] = [r[f] if mask >> i & 1 else base[f] for i, f in enumerate(feats)]
    mixed = spark.createDataFrame([(i * 8 + k, *v) for (i, k), v in values.items()], "id long, x double, z double, c string")
    margin = {r.id: r.margin for r in X.margin_of(m)(mixed).collect()}
    for r in got:
        assert 1 / (1 + math.exp(-2 * r.margin)) == pytest.approx(want[r.id])
        assert r.base_margin + sum(c.impact for c in r.contrib) == pytest.approx(r.margin)
        for i, c in enumerate(r.contrib):            # three features have six orders: all of them are used
            exact = 0.0
            for order in itertools.permutations(range(3)):
                before = sum(1 << g for g in order[:order.index(i)])
                exact += (margin[r.id * 8 + (before | 1 << i)] - margin[r.id * 8 + before]) / 6
            assert c.feature == feats[i] and c.impact == pytest.approx(exact, abs=1e-9)


def test_scoring_keeps_every_row(spark):
    from riskloom.operators import explain as X
    from riskloom.operators.score import score_split
    df = _small(spark, 300).withColumn("has_label", F.col("id") % 3 > 0)
    feats = ["x", "z", "c"]
    payload = F.when(F.col("id") == 5, "{broken").when(F.col("id") == 6, None).when(F.col("id") == 7, '{"k": "word"}') \
        .when(F.col("id") == 8, "{}").otherwise('{"k": 4}')
    rows = FE.parse_payload(df.withColumn("props", payload), "props", {"k": "long"})
    assert {r.id: r.error for r in rows.where("id between 5 and 9").collect()} == \
        {5: "malformed payload", 6: "missing payload", 7: "malformed payload", 8: None, 9: None}
    m = L.fit_classifier(df, feats, ["c"], kind="gbt", params=L.TreeParams(max_iter=3, max_depth=3))
    cal = L.fit_calibrator(L.predict_proba(m, df, feats, ["c"], keep=["id", "is_fraud"]), "proba", "is_fraud")
    out = {r.id: r for r in score_split(rows, m, cal, feats, ["c"], X.base_row(df, feats, ["c"]), error="error").collect()}
    assert set(out) == set(range(300))
    for i, r in out.items():
        if i in (5, 6, 7):
            assert r.error and r.risk_score is None and r.level is None and r.reason_1_feature is None
        else:
            assert r.error is None and 0 < r.risk_score < 1 and r.reason_1_value is not None
            assert abs(r.reason_1_impact) >= abs(r.reason_2_impact) >= abs(r.reason_3_impact)


def test_trees_are_scored_by_leaves_as_one_by_one(spark):
    """What each round adds is what that tree predicts, categories included, with one call of the model for a row."""
    df = spark.range(600).select("id", (F.col("id") * 7919 % 101 % 3 == 0).cast("int").alias("is_fraud"), (F.col("id") * 37 % 91).cast("double").alias("x"),
                                 F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 3 == 0, "b").otherwise("c").alias("c"))
    m = L.fit_classifier(df, ["x", "c"], ["c"], val=df, params=L.TreeParams(max_iter=9, max_depth=4))
    rows = m.stages.transform(L.prepare_matrix(df, ["x", "c"], ["c"], keep=["id", "is_fraud"]))
    for rounds in (1, 9):
        want = rows
        for k, tree in enumerate(m.model.trees[:rounds]):
            want = tree.transform(want, {tree.predictionCol: f"t{k}"})
        steps = L._tree_columns(m.model, rows, rounds)
        assert "__leaves" not in steps.columns
        got = {r["id"]: r["__steps"] for r in steps.collect()}
        assert got == {r["id"]: [r[f"t{k}"] * m.model.treeWeights[k] for k in range(rounds)] for r in want.collect()}
    plan = L._tree_columns(m.model, rows, 9).select("__steps")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(features") <= 1
    seen = L._tree_columns(m.model, rows, 9).select(F.col("is_fraud").alias("y"), "__steps").collect()
    from riskloom.operators.metrics import evaluate
    for rounds, ap in m.history:
        p = spark.createDataFrame([(r["y"], 1 / (1 + math.exp(-2 * sum(r["__steps"][:rounds])))) for r in seen], "y int, p double")
        assert evaluate(p).first().pr_auc == pytest.approx(ap, abs=1e-6)


def _tx(spark, ids):
    rows = [(i, datetime(2024, 1, 1 + i % 25, i % 24), i % 3, i % 4, "ab"[i % 2], "vm"[i % 2], float(i), i % 3 != 0, i % 2) for i in ids]
    return spark.createDataFrame(rows, "id long, date timestamp_ntz, client_id long, merchant_id long, mcc_str string, card_brand string, "
                                       "amount double, has_label boolean, is_fraud int")


def test_features_are_joined_at_once(spark):
    """The rates do not compute the windows again; where ids come twice, the rows are those of one join after the other."""
    from riskloom.operators import risk as RK
    from riskloom.operators import windows as W
    from riskloom.plans import q_ml as Q

    for ids in ([*range(60), None], [*range(60), 7, 7]):
        t = _tx(spark, [i for i in ids if i is not None])
        if None in ids:
            t = t.unionByName(_tx(spark, [61, 62]).withColumn("id", F.lit(None).cast("long")))
        one_by_one = RK.add_risk_aggregates(W.add_velocity(t, "client_id", "user", windows=Q.ML_WINDOWS))
        out = Q.ml_features(t)
        assert out.columns == one_by_one.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, one_by_one.collect()))
        if None in ids:
            assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_mixtures_are_not_sorted(spark):
    """The mixtures of a row meet in a hash aggregate; what the row keeps is in no aggregate of theirs. Rows without id stay."""
    from riskloom.operators import explain as X

    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 7.0), (None, 4.0, 1.0)], "id long, a double, b double")
    out = X.shapley_contributions(df, ["a", "b"], {"a": 0.0, "b": 0.0}, lambda d: d.withColumn("margin", F.col("a") * F.col("b")), ["id", "a"])
    got = {r["id"]: (r["a"], r["margin"], [round(c["impact"], 9) for c in r["contrib"]], [c["value"] for c in r["contrib"]]) for r in out.collect()}
    assert {k: v[:3] for k, v in got.items()} == {1: (1.0, 5.0, [2.5, 2.5]), 2: (3.0, 21.0, [10.5, 10.5]), None: (4.0, 4.0, [2.0, 2.0])}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and not any("__mask" in line for line in plan.splitlines() if "SortAggregate" in line)


def test_benchmark_fits_kinds_concurrently(spark, tmp_path, monkeypatch):
    """All kinds are in work before one has ended, and all are in the log."""
    began, together = [], threading.Barrier(3, timeout=120)
    real = L.fit_classifier

    def fit(train, features, cats, *, kind="gbt", **kw):
        if kind in ("gbt", "rf", "lr") and kind not in began:
            began.append(kind)
            together.wait()
        return real(train, features, cats, kind=kind, **kw)

    monkeypatch.setattr(L, "fit_classifier", fit)
    df = spark.range(200).select("id", (F.col("id") % 7 == 0).cast("int").alias("is_fraud"), (F.col("id") % 7).cast("double").alias("x"))
    log = str(tmp_path / "runs")
    out = L.run_benchmark(df, df, ["x"], [], kinds=("gbt", "rf", "lr"), params=L.TreeParams(max_iter=2, max_depth=2), log=log)
    assert [r["model"] for r in out.collect()][::4] == ["gbt", "rf", "lr"]
    assert {r["model_type"] for r in spark.read.parquet(log).collect()} == {"gbt", "rf", "lr"}
