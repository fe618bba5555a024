"""Attributions and reason codes.

Linear models get exact additive attributions as Column expressions:
impact_j = coef_j * (x_j - mean_j), so sum_j impact_j + base = margin.
Any other model gets Shapley-type attributions of its margin against a base row
(means and most frequent categories): features change from the base's value to
the row's one after the other, and each change of the margin belongs to its
feature.  Every order adds up to margin - base margin; several orders and their
reverses are averaged.  The rows in between are scored by the model itself.
Reason codes are the top-k impacts by magnitude inside each row
(``array_sort`` with a comparator, then ``slice``) - no row loop.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import display_value
from riskloom.operators.features import prepare_matrix


def linear_contributions(df: DataFrame, coefs: dict[str, float], means: dict[str, float],
                         out: str = "contrib") -> DataFrame:
    """X1 (linear): ``out`` = array<struct<feature, impact, value>>."""
    items = [F.struct(F.lit(f).alias("feature"),
                      (F.lit(float(c)) * (F.col(f).cast("double") - F.lit(float(means[f])))).alias("impact"),
                      display_value(F.col(f)).alias("value"))
             for f, c in coefs.items()]
    return df.withColumn(out, F.array(*items))


def base_row(df: DataFrame, features: list[str], cats: list[str]) -> dict[str, float | str]:
    """The row that attributions start from: means of numeric features, most frequent categories (one bounded row)."""
    m = prepare_matrix(df, features, cats)
    row = m.agg(*[(F.mode(c, True) if c in cats else F.avg(c)).alias(c) for c in features]).first()
    return row.asDict()


def feature_orders(features: list[str], orders: int, seed: int) -> list[list[int]]:
    """``orders`` random orders of the features and their reverses, distinct where that many exist."""
    rng, out = random.Random(seed), []
    for _ in range(50 * orders):
        if len(out) >= 2 * orders:
            break
        o = list(range(len(features)))
        rng.shuffle(o)
        out += [x for x in (o, o[::-1]) if x not in out]
    return out


def shapley_contributions(df: DataFrame, features: list[str], base: dict[str, float | str], margin: Callable[[DataFrame], DataFrame],
                          keep: list[str], id_col: str = "id", orders: int = 2, seed: int = 42, out: str = "contrib") -> DataFrame:
    """X1 (any model): ``keep``, ``margin``, ``base_margin`` and ``out`` = array<struct<feature, impact, value>>.

    ``df`` holds prepared features (no NULLs) and a unique id; ``margin`` adds a
    column ``margin`` to such rows and keeps the others.  base_margin + sum of
    impacts = margin.  Each row is scored once for each distinct mixture of its
    own and the base's values, 2 * orders * (features - 1) + 2 at most.
    """
    n = len(features)
    walks = feature_orders(features, orders, seed)
    masks = sorted({sum(1 << f for f in w[:k]) for w in walks for k in range(n + 1)})
    own = {f: F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f)).otherwise(F.lit(base[f]).cast(df.schema[f].dataType))
           for i, f in enumerate(features)}
    parts = {c: F.col(c) for c in [id_col, *keep]} | {f"__show_{f}": display_value(F.col(f)) for f in features}
    kept = F.named_struct(*[x for n, c in parts.items() for x in (F.lit(n), c)])
    mixed = df.select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("__mask")) \
        .select(F.col(id_col).alias("__id"), "__mask", *[own[f].alias(f) for f in features])
    # One row again: the margin of each mixture by its mask. What a row keeps is a struct, which no hash aggregate
    # takes, so it comes by a join and is in no sort of the mixtures.
    margins = margin(mixed).groupBy("__id").agg(*[F.max(F.when(F.col("__mask") == m, F.col("margin"))).alias(f"__m{m}") for m in masks])
    shown = df.groupBy(F.col(id_col).alias("__of")).agg(F.max(kept).alias("__kept"))
    whole = margins.join(shown, F.col("__id").eqNullSafe(F.col("__of")))
    impacts = []
    for i, f in enumerate(features):
        steps = []
        for w in walks:
            before = sum(1 << g for g in w[:w.index(i)])
            steps.append(F.col(f"__m{before | 1 << i}") - F.col(f"__m{before}"))
        impacts.append(F.struct(F.lit(f).alias("feature"), (sum(steps[1:], steps[0]) / F.lit(float(len(steps)))).alias("impact"),
                                F.col(f"__kept.__show_{f}").alias("value")))
    return whole.select(*[F.col(f"__kept.{c}").alias(c) for c in keep], F.col(f"__m{masks[-1]}").alias("margin"),
                        F.col("__m0").alias("base_margin"), F.array(*impacts).alias(out))


def margin_of(model) -> Callable[[DataFrame], DataFrame]:
    """The function that adds ``margin`` (raw score of the positive class) and ``proba`` to prepared rows."""
    def run(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        if "margin" in out.columns:
            return out
        return out.withColumn("margin", vector_to_array("rawPrediction")[1]).withColumn("proba", vector_to_array("probability")[1])
    return run


def top_k_by_magnitude(arr: Column, k: int) -> Column:
    """O3: the k entries with the largest |impact| (ties by feature name)."""
    def cmp(a, b):
        return (F.when(F.abs(a.impact) > F.abs(b.impact), -1).when(F.abs(a.impact) < F.abs(b.impact), 1)
                .when(a.feature < b.feature, -1).when(a.feature > b.feature, 1).otherwise(0))
    return F.slice(F.array_sort(arr, cmp), 1, k)


def reason_codes(df: DataFrame, contrib: str = "contrib", k: int = 5, out: str = "reason_codes") -> DataFrame:
    """Top-k signed impacts per row."""
    return df.withColumn(out, top_k_by_magnitude(F.col(contrib), k))


def widen_reasons(df: DataFrame, col: str = "reason_codes", k: int = 3) -> DataFrame:
    """reason_j_feature / reason_j_impact / reason_j_value columns for a CSV sink."""
    return df.withColumns({f"reason_{j + 1}_{part}": F.get(F.col(col), F.lit(j))[part] for j in range(k)
                           for part in ("feature", "impact", "value")})


def global_importance(df: DataFrame, contrib: str = "contrib", top_n: int = 20) -> DataFrame:
    """Mean |impact| per feature (posexplode + avg), top N."""
    e = df.select(F.explode(contrib).alias("c"))
    g = e.groupBy(F.col("c.feature").alias("feature")).agg(F.avg(F.abs(F.col("c.impact"))).alias("importance"))
    return g.orderBy(F.desc("importance"), "feature").limit(top_n)
