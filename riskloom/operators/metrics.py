"""Evaluation metrics on a scored table (y 0/1, p score) - SURVEY M1-M13.

Every curve metric (PR-AUC, ROC-AUC, recall@precision, KS) is read off one
*distinct-score table*: ``groupBy(keys, p)`` with positive/negative counts
(map-side combined, so a score shared by a third of all rows is one row),
plus cumulative counts in descending score order computed with the
two-level bucketed prefix sum - never a single-task ``Window.orderBy``.
``keys`` lets the same code run per model or per period.

Average precision is the step sum over distinct thresholds (not Spark's
trapezoidal ``areaUnderPR``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.prefix import bucketed_running_sums

SCORE_RESOLUTION = 1 << 20
ALL = "__all"


def _score_cells(df: DataFrame, keys: list[str] | None, y: str, p: str) -> tuple[DataFrame, list[str]]:
    """Rows per (keys, score): ``n`` and ``n_pos`` of all rows, ``pos`` and ``neg`` of those with score and label
    (the score is NULL for the others).

    An empty key list becomes one constant group key, which is there even
    without rows, so totals attach with an ordinary equi-join (one row per key).
    """
    label = F.col(y).cast("long")
    score = F.when(F.col(p).isNotNull() & label.isNotNull(), F.col(p).cast("double"))
    rows = df.select(*(keys or [F.lit(0).alias(ALL)]), score.alias("p"), label.alias("y"), F.lit(1).cast("long").alias("one"))
    if not keys:
        none = df.sparkSession.range(1).select(F.lit(0).alias(ALL), F.lit(None).cast("double").alias("p"),
                                               F.lit(None).cast("long").alias("y"), F.lit(0).cast("long").alias("one"))
        rows, keys = rows.unionByName(none), [ALL]
    known = F.col("p").isNotNull()
    cells = rows.groupBy(*keys, "p").agg(F.sum("one").alias("n"), F.sum("y").alias("n_pos"),
                                         F.coalesce(F.sum(F.when(known, F.col("y"))), F.lit(0)).alias("pos"),
                                         F.sum(F.when(known, F.lit(1) - F.col("y")).otherwise(0)).alias("neg"))
    return cells, list(keys)


def _cumulative(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with cum_* (rows with score >= p) and tot_*: running sums inside slices of the scores, over the
    few slice sums of each key."""
    cells = cells.withColumn("__slice", F.floor(-F.col("p") * F.lit(SCORE_RESOLUTION)).cast("long"))
    slices = cells.groupBy(*keys, "__slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    slices = slices.select(*[F.col(c).alias(f"__k_{c}") for c in [*keys, "__slice"]],
                           *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b{c}") for c in ("sp", "sn")],
                           F.sum("sp").over(whole).alias("tot_pos"), F.sum("sn").over(whole).alias("tot_neg"))
    upto = Window.partitionBy(*keys, "__slice").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cells.select("*", F.sum("pos").over(upto).alias("__wp"), F.sum("neg").over(upto).alias("__wn"))
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*keys, "__slice"]]
    return inside.join(slices, on).select(*cells.drop("__slice").columns, (F.col("__bsp") + F.col("__wp")).alias("cum_pos"),
                                          (F.col("__bsn") + F.col("__wn")).alias("cum_neg"), "tot_pos", "tot_neg")


def score_table(df: DataFrame, keys: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """(keys, p, pos, neg, cum_pos, cum_neg, tot_pos, tot_neg): cum_* count rows with score >= p."""
    cells, keys = _score_cells(df, keys, y, p)
    return _cumulative(cells.where("p is not null"), keys).drop("n", "n_pos", ALL)


def curve_metrics(df: DataFrame, keys: list[str] | None = None, y: str = "y", p: str = "p",
                  min_precision: float = 0.9) -> DataFrame:
    """M1-M4, M7 (stat) per key: n, n_pos, brier, pr_auc, roc_auc, recall_at_precision, ks_stat, all read
    from one distinct-score table."""
    cells, group = _score_cells(df, keys, y, p)
    t = _cumulative(cells, group)
    prec = F.try_divide(F.col("cum_pos").cast("double"), (F.col("cum_pos") + F.col("cum_neg")).cast("double"))
    rec = F.try_divide(F.col("cum_pos").cast("double"), F.col("tot_pos").cast("double"))
    fall = F.try_divide(F.col("cum_neg").cast("double"), F.col("tot_neg").cast("double"))
    below = F.col("tot_neg") - F.col("cum_neg")
    tot_pos, tot_neg = F.max("tot_pos"), F.max("tot_neg")
    square = F.col("pos") * F.pow(F.col("p") - 1, 2) + F.col("neg") * F.pow("p", 2)
    out = t.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"),
        F.try_divide(F.sum(square), (tot_pos + tot_neg).cast("double")).alias("brier"),
        F.try_divide(F.sum(F.col("pos") * prec), tot_pos.cast("double")).alias("pr_auc"),
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)), (tot_pos * tot_neg).cast("double")).alias("roc_auc"),
        F.when(tot_pos > 0, F.coalesce(F.max(F.when(prec >= min_precision, rec)), F.lit(0.0))).alias("recall_at_precision"),
        F.when((tot_pos > 0) & (tot_neg > 0), F.max(F.abs(rec - fall))).otherwise(F.lit(0.0)).alias("ks_stat"))
    return out.drop(ALL)


def brier(df: DataFrame, keys: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """M3: mean squared error of the probability."""
    return df.groupBy(*(keys or [])).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def evaluate(df: DataFrame, keys: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """M5: n, n_pos, pr_auc, roc_auc, brier, recall_at_precision_90 per key.  Without
    keys there is always one row: n 0 and NULL metrics for an empty input."""
    return curve_metrics(df, keys, y, p).select(*(keys or []), "n", "n_pos", "brier", "pr_auc", "roc_auc",
                                                F.col("recall_at_precision").alias("recall_at_precision_90"))


def confusion_matrix(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p",
                     keys: list[str] | None = None) -> DataFrame:
    """M6: tp, fp, tn, fn, precision, recall, f1, specificity (0 when undefined)."""
    pred = F.col(p) >= F.lit(threshold)
    pos = F.col(y) == 1
    neg = F.col(y) == 0
    one = df.groupBy(*(keys or [])).agg(
        F.count_if(pred & pos).alias("tp"), F.count_if(pred & neg).alias("fp"),
        F.count_if(~pred & neg).alias("tn"), F.count_if(~pred & pos).alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    pr = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rc = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.select(F.lit(float(threshold)).alias("threshold"), *(keys or []), "tp", "fp", "tn", "fn",
                      pr.alias("precision"), rc.alias("recall"),
                      F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"),
                      ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def _grid_index(p: Column, n_points: int) -> Column:
    """Largest i with grid_i <= p for grid = linspace(0, 1, n_points) computed
    as i * (1 / (n_points - 1)) with the last point exactly 1.0; -1 below 0."""
    div = n_points - 1
    step = F.lit(1.0 / div)
    i0 = F.least(F.greatest(F.floor(p * F.lit(float(div))).cast("int"), F.lit(0)), F.lit(div))

    def g(i: Column) -> Column:
        return F.when(i >= div, F.lit(1.0)).otherwise(i.cast("double") * step)

    up = F.when((i0 + 1 <= div) & (g(i0 + 1) <= p), i0 + 1).otherwise(i0)
    down = F.when(g(up) > p, up - 1).otherwise(up)
    return F.when(p < 0, F.lit(-1)).otherwise(down)


def ks_threshold(df: DataFrame, y: str = "y", p: str = "p", n_points: int = 200) -> DataFrame:
    """M7 threshold: first grid point of linspace(0,1,200) maximising
    TPR(t) - FPR(t) with rates over scores >= t; 0.5 when a class is empty.
    Rows are reduced to <= n_points grid cells before any window."""
    spark = df.sparkSession
    cells = df.where(F.col(p).isNotNull()).groupBy(_grid_index(F.col(p), n_points).alias("g")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(y).cast("long"))).alias("neg"))
    grid = spark.range(n_points).select(F.col("id").cast("int").alias("g"))
    j = grid.join(F.broadcast(cells), "g", "left").fillna(0, ["pos", "neg"])
    w = Window.orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 200 rows
    c = j.select("g", F.sum("pos").over(w).alias("cp"), F.sum("neg").over(w).alias("cn"),
                 F.sum("pos").over(Window.partitionBy()).alias("tot_pos"), F.sum("neg").over(Window.partitionBy()).alias("tot_neg"))
    t = F.when(F.col("g") >= n_points - 1, F.lit(1.0)).otherwise(F.col("g").cast("double") * F.lit(1.0 / (n_points - 1)))
    d = c.select(t.alias("t"), "g", "tot_pos", "tot_neg", (F.try_divide(F.col("cp").cast("double"), F.col("tot_pos").cast("double"))
                  - F.try_divide(F.col("cn").cast("double"), F.col("tot_neg").cast("double"))).alias("d"))
    best = d.orderBy(F.col("d").desc_nulls_last(), F.col("g").asc()).limit(1)
    return best.select(F.when((F.col("tot_pos") > 0) & (F.col("tot_neg") > 0), F.col("t")).otherwise(F.lit(0.5))
                       .alias("ks_threshold"))


def ks_statistic(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M7: ks_stat, asymptotic p_value (Kolmogorov series, Stephens' small-sample
    factor), ks_threshold.  Empty class -> (0, 1, 0.5)."""
    t = _cumulative(*_score_cells(df, None, y, p))
    rec, fall = (F.try_divide(F.col(f"cum_{c}").cast("double"), F.col(f"tot_{c}").cast("double")) for c in ("pos", "neg"))
    cm = t.groupBy(ALL).agg(F.max("tot_pos").alias("n1"), F.max("tot_neg").alias("n0"),
                            F.coalesce(F.max(F.abs(rec - fall)), F.lit(0.0)).alias("ks_stat"))
    en = F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0")))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks_stat")
    sign = lambda k: F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))                                 # noqa: E731
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + sign(k) * F.exp(-2.0 * k * k * lam * lam))
    pval = F.when((F.col("n1") > 0) & (F.col("n0") > 0),
                  F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))).otherwise(F.lit(1.0))
    th = ks_threshold(df, y, p).withColumn(ALL, F.lit(0))
    return cm.join(th, ALL).select("ks_stat", pval.alias("p_value"), "ks_threshold")


def global_rank(df: DataFrame, p: str = "p", id_col: str = "id") -> DataFrame:
    """Row number in (p desc, id asc) order without a single-task window:
    rows before = cumulative count of higher scores (distinct-score table),
    plus the rank inside the tie group, itself computed in id slices so a
    score shared by a third of all rows is still split."""
    g = df.groupBy(p).agg(F.count(F.lit(1)).alias("__c"))
    g = g.withColumn("__sb", F.floor(-F.col(p) * F.lit(SCORE_RESOLUTION)).cast("long"))
    before = bucketed_running_sums(g, [], "__sb", [F.col(p).desc()], {"__before": F.col("__c")}) \
        .select(F.col(p).alias("__p"), "__before")
    staged = df.withColumn("__ib", F.floor(F.col(id_col) / F.lit(1 << 16)).cast("long"))
    tied = bucketed_running_sums(staged, [p], "__ib", [F.col(id_col)], {"__tie": F.lit(1).cast("long")},
                                 inclusive=True).drop("__ib")
    j = tied.join(before, F.col(p).eqNullSafe(F.col("__p")), "left")
    return j.withColumn("rank", F.col("__before") + F.col("__tie")).drop("__p", "__before", "__tie")


def lift_table(df: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p", id_col: str = "id") -> DataFrame:
    """M8: deciles by descending score of size n // bins (last takes the
    remainder): decile, n, n_fraud, fraud_rate, lift.  Empty without fraud."""
    spark = df.sparkSession
    tot = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")).first()
    n, pos = int(tot["n"]), int(tot["pos"] or 0)
    schema = "decile int, n long, n_fraud long, fraud_rate double, lift double"
    if n == 0 or pos == 0:
        return spark.createDataFrame([], schema)
    size = n // n_bins
    r = global_rank(df, p, id_col)
    if size == 0:
        dec = F.lit(n_bins - 1)
    else:
        dec = F.least(F.floor((F.col("rank") - 1) / F.lit(size)).cast("int"), F.lit(n_bins - 1))
    cells = r.groupBy(dec.alias("d")).agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.col(y).cast("long")).alias("n_fraud"))
    grid = spark.range(n_bins).select(F.col("id").cast("int").alias("d"))
    j = grid.join(F.broadcast(cells), "d", "left").fillna(0, ["n", "n_fraud"])
    overall = pos / n
    rate = F.try_divide(F.col("n_fraud").cast("double"), F.col("n").cast("double"))
    return j.select((F.col("d") + 1).alias("decile"), "n", "n_fraud", rate.alias("fraud_rate"),
                    (rate / F.lit(overall)).alias("lift"))


def gain_table(df: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p", id_col: str = "id") -> DataFrame:
    """M9: cumulative share of population and of fraud per decile (<= 10-row window)."""
    lt = lift_table(df, n_bins, y, p, id_col)
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy()
    return lt.select("decile",
                     (F.sum("n").over(w) / F.sum("n").over(tot)).alias("pct_population"),
                     (F.sum("n_fraud").over(w) / F.sum("n_fraud").over(tot)).alias("pct_fraud_captured"))


def _calib_bin(p: Column, n_bins: int) -> Column:
    """Bin i with edge_i <= p < edge_(i+1) for edges = linspace(0,1,n_bins+1),
    last bin closed; NULL outside [0, 1]."""
    i = _grid_index(p, n_bins + 1)
    return F.when((p < 0) | (p > 1), F.lit(None)).otherwise(F.least(i, F.lit(n_bins - 1)))


def calibration_curve(df: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """bin_lower, bin_upper, mean_predicted, fraction_positive, count; empty bins omitted."""
    step = 1.0 / n_bins
    b = _calib_bin(F.col(p), n_bins)
    g = df.where(b.isNotNull()).groupBy(b.alias("bin")).agg(
        F.avg(F.col(p)).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("count"))

    def edge(i: Column) -> Column:
        return F.when(i >= n_bins, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))

    return g.select("bin", edge(F.col("bin")).alias("bin_lower"), edge(F.col("bin") + 1).alias("bin_upper"),
                    "mean_predicted", "fraction_positive", "count")


def expected_calibration_error(df: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Count-weighted mean |fraction_positive - mean_predicted|; 0 without bins."""
    c = calibration_curve(df, n_bins, y, p)
    return c.agg(F.coalesce(F.try_divide(F.sum(F.col("count") * F.abs(F.col("fraction_positive") - F.col("mean_predicted"))),
                                         F.sum("count").cast("double")), F.lit(0.0)).alias("ece"))


LOWER_IS_BETTER = ("brier", "ece")


def leaderboard(metrics_long: DataFrame, primary: str = "pr_auc") -> DataFrame:
    """Models ranked by the primary metric (descending)."""
    wide = metrics_long.where(F.col("metric") == primary).select("model", F.col("value").alias(primary))
    w = Window.orderBy(F.col(primary).desc(), F.col("model"))  # one row per model
    return wide.withColumn("position", F.row_number().over(w))


def metric_winners(metrics_long: DataFrame) -> DataFrame:
    """Per metric, the best model (max; min for brier/ece); ties share rank 1."""
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("metric").orderBy(signed)
    return metrics_long.withColumn("rank", F.rank().over(w)).where(F.col("rank") == 1) \
        .select("metric", "model", "value")
