"""Curve metrics against brute-force definitions (ties, degenerate classes)."""

import random

import pytest

from riskloom.operators import metrics as M


def ap_brute(ys, ps):
    pairs = sorted(zip(ps, ys), key=lambda t: -t[0])
    P = sum(ys)
    thr = sorted(set(ps), reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for p, y in pairs if p >= t and y == 1)
        n = sum(1 for p, y in pairs if p >= t)
        r = tp / P
        ap += (r - prev_r) * (tp / n)
        prev_r = r
    return ap


def roc_brute(ys, ps):
    pos = [p for p, y in zip(ps, ys) if y == 1]
    neg = [p for p, y in zip(ps, ys) if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def data(n=300, seed=1):
    rng = random.Random(seed)
    ys = [1 if rng.random() < 0.2 else 0 for _ in range(n)]
    ps = [round(min(1, max(0, rng.random() * 0.6 + 0.4 * y)), 1) for y in ys]  # heavy ties
    return ys, ps


def test_ap_roc_with_ties(spark):
    ys, ps = data()
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip(ys, ps))], "id long, y int, p double")
    r = M.evaluate(df).first()
    assert r.pr_auc == pytest.approx(ap_brute(ys, ps))
    assert r.roc_auc == pytest.approx(roc_brute(ys, ps))


def test_all_scores_equal(spark):
    df = spark.createDataFrame([(i, i % 2, 0.8) for i in range(10)], "id long, y int, p double")
    r = M.evaluate(df).first()
    assert r.pr_auc == pytest.approx(0.5) and r.roc_auc == pytest.approx(0.5) and r.brier is not None


def test_no_positives_and_empty(spark):
    df = spark.createDataFrame([(i, 0, 0.1 * i) for i in range(5)], "id long, y int, p double")
    r = M.evaluate(df).first()
    assert r.pr_auc is None and r.recall_at_precision_90 is None
    empty = spark.createDataFrame([], "id long, y int, p double")
    assert M.evaluate(empty).count() == 0 or M.evaluate(empty).first().pr_auc is None
    assert M.lift_table(df).count() == 0


def test_brier(spark):
    a = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 1.0), (1, 1.0)], "y int, p double")
    b = spark.createDataFrame([(0, 1.0), (1, 0.0)], "y int, p double")
    assert M.brier(a).first().brier == 0.0 and M.brier(b).first().brier == 1.0


def test_lift_remainder_and_gain(spark):
    ys, ps = data(103, seed=4)
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip(ys, ps))], "id long, y int, p double")
    lt = sorted(M.lift_table(df).collect(), key=lambda r: r.decile)
    assert [r.n for r in lt] == [10] * 9 + [13]
    order = sorted(range(103), key=lambda i: (-ps[i], i))
    assert lt[0].n_fraud == sum(ys[i] for i in order[:10])
    g = sorted(M.gain_table(df).collect(), key=lambda r: r.decile)
    assert g[-1].pct_population == pytest.approx(1.0) and g[-1].pct_fraud_captured == pytest.approx(1.0)


def test_global_rank_hot_tie_group(spark):
    rows = [(i, i % 2, 0.5 if i < 600 else i / 1000.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    got = {r.id: r.rank for r in M.global_rank(df).collect()}
    exp = {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (-rows[i][2], i)))}
    assert got == exp


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0, 0.3), (1, 1.0), (0, 0.0), (1, 0.7)], "y int, p double")
    bins = {round(r.bin_lower, 6): r["count"] for r in M.calibration_curve(df).collect()}
    assert bins[0.9] == 1  # 1.0 falls in the closed last bin
    assert bins[0.2] == 1  # 0.3 < 3 * 0.1 in floating point, as with linspace
    assert M.expected_calibration_error(df).first().ece >= 0


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.1), (0, 0.2)], "y int, p double")
    r = M.confusion_matrix(df, 0.5).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1) and r.f1 == pytest.approx(0.5)


def test_ks(spark):
    ys, ps = data(200, seed=2)
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip(ys, ps))], "id long, y int, p double")
    r = M.ks_statistic(df).first()
    pos = [p for p, y in zip(ps, ys) if y]
    neg = [p for p, y in zip(ps, ys) if not y]
    exp = max(abs(sum(q <= x for q in pos) / len(pos) - sum(q <= x for q in neg) / len(neg)) for x in set(ps))
    assert r.ks_stat == pytest.approx(exp) and 0 <= r.p_value <= 1
    one = spark.createDataFrame([(1, 0, 0.3)], "id long, y int, p double")
    r1 = M.ks_statistic(one).first()
    assert (r1.ks_stat, r1.p_value, r1.ks_threshold) == (0.0, 1.0, 0.5)
