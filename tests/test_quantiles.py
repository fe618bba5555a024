"""Exact quantiles by distributed selection against sorted lists."""

import math
import random

import pytest

from riskloom.operators import eda
from riskloom.operators import quantiles as Q


def brute(xs, q):
    xs = sorted(x for x in xs if x is not None)
    if not xs:
        return None
    at = q * (len(xs) - 1)
    k = math.floor(at)
    return xs[k] if at == k else (k + 1 - at) * xs[k] + (at - k) * xs[k + 1]


PROBS = [0.0, 0.0001, 0.01, 0.25, 0.5, 0.731, 0.99, 0.9999, 1.0]


@pytest.mark.parametrize("n", [1, 2, 7, 500, 30_000])
def test_equals_sorted_list(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 0.0, 1.0, rng.gauss(0, 5)]), float(rng.randint(0, 3)), rng.lognormvariate(3, 2)) for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    got = Q.exact_quantiles(df, {"a": PROBS, "b": PROBS, "c": [0.5]})
    for k, c in enumerate("ab"):
        want = [brute([r[k] for r in rows], q) for q in PROBS]
        assert got[c] == pytest.approx(want) if want[0] is not None else got[c] == [None] * len(PROBS)
    assert got["c"] == pytest.approx([brute([r[2] for r in rows], 0.5)])


def test_many_rows_in_a_bracket_are_narrowed_first(spark, monkeypatch):
    monkeypatch.setattr(Q, "SORT_ROWS", 10)
    df = spark.range(60_000).selectExpr("cast(pmod(xxhash64(id), 50000) as double) as x")
    xs = [r.x for r in df.collect()]
    assert Q.exact_quantiles(df, {"x": [0.25, 0.5, 0.999]})["x"] == pytest.approx([brute(xs, q) for q in (0.25, 0.5, 0.999)])


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    df = spark.range(40_000).selectExpr("cast(id as double) as x")
    monkeypatch.setattr(Q, "_SLACK", 1e-3)
    real = Q._merged
    calls = []

    def wrong(ts):
        calls.append(len(ts))
        return [(-5.0, -4.0)] if len(calls) == 1 else real(ts)
    monkeypatch.setattr(Q, "_merged", wrong)
    assert Q.exact_quantiles(df, {"x": [0.5]})["x"] == pytest.approx([19_999.5]) and len(calls) > 1


def test_no_values_nan_and_no_buffered_percentile(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 1.0), (None, 2.0)], "a double, b double")
    got = Q.exact_quantiles(df, {"a": [0.5], "b": [0.5, 1.0]})
    assert got["a"] == [None] and got["b"][0] == 2.0 and math.isnan(got["b"][1])
    assert Q.exact_quantiles(df, {}) == {}
    plan = eda.numeric_summary(df.select("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_box_stats_and_categories(spark):
    rows = [(float(x), "v" if x % 2 else None) for x in [1, 2, 3, 4, 5, 6, 7, 100]] + [(None, "w")]
    df = spark.createDataFrame(rows, "x double, c string")
    b = eda.box_stats(df, ["x"]).first()
    assert (b.q1, b.median, b.q3, b.whisker_lo, b.whisker_hi, b.n_outliers, b.min, b.max) == (2.75, 4.5, 6.25, 1.0, 7.0, 1, 1.0, 100.0)
    assert eda.box_stats(df.where("x > 1000"), ["x"]).first().q1 is None
    got = [(r.value, r["count"], r.pct, r["rank"]) for r in eda.categorical_summary(df, ["c"], 2).orderBy("rank").collect()]
    assert got == [("v", 4, 44.44, 1), (None, 4, 44.44, 2)] or got == [(None, 4, 44.44, 1), ("v", 4, 44.44, 2)]
    plan = eda.categorical_summary(df, ["c"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan                # cut in each task before the rank shuffle
