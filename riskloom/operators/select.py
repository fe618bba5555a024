"""Feature selection.

All data passes are Spark aggregations; the driver only handles p x p
matrices of scalars (p = number of candidate features, bounded).
"""

from __future__ import annotations

import random
import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskloom.operators import eda
from riskloom.operators.metrics import curve_metrics
from riskloom.session import materialize


def correlation_filter(df: DataFrame, features: list[str], threshold: float = 0.95) -> tuple[list[str], list[str]]:
    """Greedy - walk features in order, drop one whose |r| with an already
    kept feature exceeds the threshold.  One aggregation for all pairs."""
    if len(features) < 2:
        return list(features), []
    rows = eda.corr_matrix(df, features).collect()  # p*(p-1)/2 scalars
    r = {(x["col_a"], x["col_b"]): x["corr"] for x in rows}
    kept, dropped = [], []
    for f in features:
        bad = any(abs(r.get((k, f), r.get((f, k))) or 0.0) > threshold for k in kept)
        (dropped if bad else kept).append(f)
    return kept, dropped


def gramian(df: DataFrame, features: list[str]) -> DataFrame:
    """X'X over listwise-complete rows in one pass: (a, b, value) for a <= b."""
    full = df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(features)
            for j, b in enumerate(features) if j >= i]
    one = full.agg(F.count(F.lit(1)).alias("n"), *aggs)
    pairs = [(i, j) for i in range(len(features)) for j in range(len(features)) if j >= i]
    body = ", ".join(f"'{features[i]}', '{features[j]}', g{i}_{j}" for i, j in pairs)
    return one.selectExpr("n", f"stack({len(pairs)}, {body}) AS (a, b, value)")


MIN_VIF_ROWS = 10


def vif_filter(df: DataFrame, features: list[str], max_vif: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Iteratively drop the feature with the largest VIF above max_vif.
    No intercept (uncentered R^2), as in the reference: VIF_i = (G^-1)_ii * G_ii.
    The Gramian is computed once; dropping a feature takes a sub-matrix.  With
    fewer than MIN_VIF_ROWS complete rows nothing can be said: every feature is
    kept, and a warning says so."""
    g = gramian(df, features).collect()
    if not g or g[0]["n"] < MIN_VIF_ROWS:
        warnings.warn(f"VIF filter skipped: {g[0]['n'] if g else 0} complete rows, {MIN_VIF_ROWS} needed", stacklevel=2)
        return list(features), []
    idx = {f: i for i, f in enumerate(features)}
    G = np.zeros((len(features), len(features)))
    for r in g:
        i, j = idx[r["a"]], idx[r["b"]]
        G[i, j] = G[j, i] = r["value"]
    keep = list(features)
    dropped = []
    while len(keep) > 1:
        ii = [idx[f] for f in keep]
        sub = G[np.ix_(ii, ii)]
        inv = np.linalg.pinv(sub)
        vifs = np.diag(inv) * np.diag(sub)
        k = int(np.argmax(vifs))
        if vifs[k] <= max_vif:
            break
        dropped.append((keep[k], float(vifs[k])))
        keep.pop(k)
    return keep, dropped


def _hash_rank(df: DataFrame, key_col: str, seed: int, out: str) -> DataFrame:
    """Rank of each row in md5 order of its key: counts of 65,536 even hash
    buckets give offsets, and rows are numbered inside their bucket."""
    from riskloom.operators.splits import hash_key
    staged = df.withColumn("__h", hash_key(key_col, seed)) \
        .withColumn("__hb", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    counts = staged.groupBy("__hb").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("__hb", F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__hb").orderBy("__h", key_col)
    return staged.join(F.broadcast(offs), "__hb") \
        .withColumn(out, F.col("__off") + F.row_number().over(inside)).drop("__h", "__hb", "__off")


def shifts(n_features: int, n_repeats: int, seed: int) -> list[list[float]]:
    """For each feature and repeat a number in [0, 1) that sets how far its column is moved."""
    rng = random.Random(seed)
    return [[round(rng.random(), 6) for _ in range(n_repeats)] for _ in range(n_features)]


def permuted_rows(df: DataFrame, features: list[str], label: str, n_repeats: int, seed: int, id_col: str) -> DataFrame:
    """(__feature, __repeat, label, features, other columns of ``df``): all rows as they are
    (feature -1), and for each feature and repeat all rows with that feature's column permuted.

    One rank pass puts the rows into a hash order of their ids; in a permuted
    column row k has the value of row k + shift of that order (cyclic), with a
    shift of its own for each feature and repeat.  So every permutation is over
    the whole table, depends on data and seed only, and costs no sort of its own:
    one join by rank brings all moved values.
    """
    types = {f: df.schema[f].dataType for f in features}
    is_num = {f: isinstance(t, NumericType) for f, t in types.items()}
    other = [c for c in df.columns if c not in (id_col, label, *features)]       # the scorer may need them
    ranked = materialize(_hash_rank(df.select(id_col, label, *features, *other), id_col, seed, "__rank").drop(id_col), "permutation-ranks")
    n = ranked.count()
    moved = []
    for i, (f, us) in enumerate(zip(features, shifts(len(features), n_repeats, seed))):
        for r, u in enumerate(us):
            shift = 1 + int(u * (n - 1)) if n > 1 else 0
            to = F.pmod(F.col("__rank") - F.lit(1 + shift), F.lit(max(n, 1))) + 1
            value = F.col(f)
            moved.append(F.struct(to.alias("to"), F.lit(i).alias("f"), F.lit(r).alias("r"),
                                  (value.cast("double") if is_num[f] else F.lit(None).cast("double")).alias("num"),
                                  (F.lit(None).cast("string") if is_num[f] else value.cast("string")).alias("txt")))
    values = ranked.select(F.explode(F.array(*moved)).alias("v")).select("v.*")
    # Sorted on both sides at every size: the rows are no data to broadcast, small as their file may be.
    joined = ranked.join(values.hint("merge"), F.col("__rank") == F.col("to"))
    own = {f: F.when(F.col("f") == i, F.col("num" if is_num[f] else "txt").cast(types[f])).otherwise(F.col(f)) for i, f in enumerate(features)}
    permuted = joined.select(F.col("f").alias("__feature"), F.col("r").alias("__repeat"), label, *[c.alias(f) for f, c in own.items()], *other)
    return permuted.unionByName(ranked.select(F.lit(-1).alias("__feature"), F.lit(0).alias("__repeat"), label, *features, *other))


def permutation_importance(scored_fn, df: DataFrame, features: list[str], label: str = "is_fraud",
                           n_repeats: int = 5, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """AP of the rows as they are minus mean AP after permuting one column
    (``n_repeats`` permutations of each).  ``scored_fn(rows, keep)`` returns the
    columns ``keep`` and proba.

    All permuted rows are scored together, and one distinct-score table keyed by
    (feature, repeat) gives every AP: the number of jobs does not depend on
    features or repeats.
    """
    keys = ["__feature", "__repeat"]
    rows = permuted_rows(df, features, label, n_repeats, seed, id_col or df.columns[0])
    scored = scored_fn(rows, [*keys, label]).select(*keys, F.col(label).alias("y"), F.col("proba").alias("p"))
    ap = {(r["__feature"], r["__repeat"]): float(r["pr_auc"] or 0.0)
          for r in curve_metrics(scored, keys).select(*keys, "pr_auc").collect()}      # features x repeats + 1 rows
    base = ap.get((-1, 0), 0.0)
    drops = [[base - ap.get((i, r), 0.0) for r in range(n_repeats)] for i in range(len(features))]
    out = [(f, float(np.mean(d)), float(np.std(d))) for f, d in zip(features, drops)]
    return df.sparkSession.createDataFrame(out, "feature string, importance double, std double")


def run_all_filters(df: DataFrame, features: list[str], corr_threshold: float = 0.95, max_vif: float = 10.0,
                    scored_fn=None, min_importance: float = 1e-4, label: str = "is_fraud",
                    n_repeats: int = 5) -> DataFrame:
    """Correlation -> VIF -> permutation importance; (feature, kept, stage).  The first column of ``df`` is its id."""
    spark = df.sparkSession
    kept, dropped_c = correlation_filter(df, features, corr_threshold)
    kept2, dropped_v = vif_filter(df, kept, max_vif)
    rows = [(f, False, "correlation") for f in dropped_c] + [(f, False, "vif") for f, _ in dropped_v]
    final = kept2
    if scored_fn is not None:
        imp = {r["feature"]: r["importance"] for r in
               permutation_importance(scored_fn, df, kept2, label=label, n_repeats=n_repeats).collect()}
        final = [f for f in kept2 if imp.get(f, 0.0) >= min_importance]
        rows += [(f, False, "permutation") for f in kept2 if f not in final]
    rows += [(f, True, "kept") for f in final]
    return spark.createDataFrame(rows, "feature string, kept boolean, stage string")
