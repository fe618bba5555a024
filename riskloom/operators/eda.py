"""Profiling aggregates.

Every profile is a single aggregation pass whose wide one-row result is
unpivoted with ``stack`` into long rows ``(column, ...)``; nothing is
collected except bounded scalars (quantiles).

Quantiles are exact (linear interpolation, equal to numpy / DuckDB
``quantile_cont``) and come from ``quantiles.exact_quantiles``: a sketch
brackets them, and only the rows inside the brackets are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from riskloom.functions.timecols import col_of
from riskloom.operators.quantiles import exact_quantiles


def _quote(s: str) -> str:
    return s.replace("'", "''")


def _stack(one: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    body = ", ".join(", ".join(r) for r in rows)
    return one.selectExpr(f"stack({len(rows)}, {body}) AS ({', '.join(names)})")


def missing_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A3: (column, missing_rate) - fraction of NULL per column."""
    cols = [c for c in (columns or df.columns) if c in df.columns]
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    return _stack(one, [[f"'{_quote(c)}'", f"m{i}"] for i, c in enumerate(cols)], ["column", "missing_rate"])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A4: count, mean, std (ddof 1), min, p25, p50, p75, max per column."""
    cols = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), *[F.lit(q).cast("double").alias(f"q{i}_{k}") for k, q in enumerate(quartiles[c])],
                 F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    rows = [[f"'{_quote(c)}'", f"n{i}", f"a{i}", f"s{i}", f"lo{i}", f"q{i}_0", f"q{i}_1", f"q{i}_2", f"hi{i}"]
            for i, c in enumerate(cols)]
    return _stack(one, rows, ["column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def categorical_summary(df: DataFrame, columns: list[str], top_n: int = 15) -> DataFrame:
    """Top-N value counts per column (NULL is a value), pct of all rows.
    Ties in count are broken by value so the top-N is deterministic.

    One scan counts the values of all columns, spread by (column, value); each
    task cuts its share to its own N best per column before the rank shuffle,
    so no task holds a column's domain.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    total = df.agg(F.count(F.lit(1)).alias("__tot")).select("__tot", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return top.join(F.broadcast(total), "column").select(       # one row for each column
        "column", "value", "count", F.round(F.col("count") * 100.0 / F.col("__tot"), 2).alias("pct"), "rank")


def schema_audit(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column dtype, null_count, null_pct, cardinality (distinct
    non-null), min/max (numeric as double, others as string)."""
    n = F.count(F.lit(1))
    aggs = [n.alias("__n")]
    fields = df.schema.fields
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [F.count_if(c.isNull()).alias(f"nul{i}"),
                 (F.approx_count_distinct(c) if approx else F.count_distinct(c)).alias(f"card{i}")]
        if isinstance(f.dataType, NumericType):
            aggs += [F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        num = isinstance(f.dataType, NumericType)
        rows.append([f"'{_quote(f.name)}'", f"'{f.dataType.simpleString()}'", f"nul{i}",
                     f"CAST(round(100.0 * nul{i} / nullif(__n, 0), 2) AS DOUBLE)", f"card{i}",
                     f"mn{i}" if num else "CAST(NULL AS DOUBLE)", f"mx{i}" if num else "CAST(NULL AS DOUBLE)"])
    body = ", ".join(", ".join(r) for r in rows)
    return one.selectExpr(f"stack({len(rows)}, {body}) AS (column, dtype, null_count, null_pct, cardinality, "
                          "min_num, max_num)")


def data_quality_checks(df: DataFrame, id_col: str | None = None, date_col: str | None = None,
                        amount_col: str | None = None, as_of: str = "2100-01-01") -> DataFrame:
    """One row.  ``as_of`` replaces the reference's wall-clock "now"."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if id_col:
        aggs += [(F.count(F.lit(1)) - F.count_distinct(id_col)).alias("duplicate_ids"),
                 F.round(F.try_divide(F.count_distinct(id_col).cast("double"), F.count(F.lit(1)).cast("double")), 4)
                 .alias("unique_id_ratio")]
    if date_col:
        d = col_of(date_col).cast("timestamp")
        aggs += [F.count_if(d.isNull()).alias("null_dates"),
                 F.count_if(d > F.to_timestamp(F.lit(as_of))).alias("future_dates"),
                 F.min(col_of(date_col)).alias("date_min"), F.max(col_of(date_col)).alias("date_max")]
    if amount_col:
        a = F.regexp_replace(col_of(amount_col).cast("string"), r"[$,\s]", "").try_cast("double")
        aggs += [F.count_if(a.isNull()).alias("null_amounts"), F.count_if(a < 0).alias("negative_amounts"),
                 F.count_if(a == 0).alias("zero_amounts")]
    return df.agg(*aggs)


def daily_volume(df: DataFrame, date_col: str = "date", amount_col: str = "amount") -> DataFrame:
    """Rows and amount per calendar day."""
    return df.groupBy(F.to_date(col_of(date_col)).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount_col).alias("amount_sum"))


def fraud_rate_by_period(df: DataFrame, date_col: str = "date", period: str = "year",
                         label_col: str = "is_fraud", has_label_col: str = "has_label") -> DataFrame:
    """Labeled rows per year (or month): total, fraud, 100 * fraud / total."""
    d = col_of(date_col)
    key = F.year(d) if period == "year" else F.date_trunc(period, d.cast("timestamp")).cast("date")
    lab = df.where(F.col(has_label_col) & F.col(label_col).isNotNull())
    return lab.groupBy(key.alias(period)).agg(
        F.count(label_col).alias("total"), F.sum(label_col).cast("long").alias("fraud")) \
        .withColumn("fraud_rate", F.col("fraud") * 100.0 / F.col("total"))


def label_coverage(df: DataFrame, has_label_col: str = "has_label", label_col: str = "is_fraud") -> DataFrame:
    """A10: rows by label presence, and labeled rows by class, in one pass."""
    one = df.agg(F.count_if(F.col(has_label_col)).alias("lab"), F.count_if(~F.col(has_label_col)).alias("unl"),
                 F.count_if(F.col(has_label_col) & (F.col(label_col) == 1)).alias("pos"),
                 F.count_if(F.col(has_label_col) & (F.col(label_col) == 0)).alias("neg"))
    return _stack(one, [["'has_label'", "'true'", "lab"], ["'has_label'", "'false'", "unl"],
                        ["'is_fraud'", "'1'", "pos"], ["'is_fraud'", "'0'", "neg"]],
                  ["dimension", "value", "n"])


def volume_by_hour_dow(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Counts per hour of day and per weekday (Mon=0)."""
    d = col_of(date_col)
    h = df.groupBy(F.hour(d).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("hour"))
    w = df.groupBy(F.weekday(d).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("dow"))
    return h.unionByName(w).select("kind", "key", "n")


def trim_bounds(df: DataFrame, col: str, lo_q: float = 0.01, hi_q: float = 0.99) -> tuple[float | None, float | None]:
    """Two quantiles as driver scalars."""
    lo, hi = exact_quantiles(df, {col: [lo_q, hi_q]})[col]
    return lo, hi


def trim_quantiles(df: DataFrame, col: str, lo_q: float = 0.01, hi_q: float = 0.99) -> DataFrame:
    """Keep rows with p01 <= x <= p99 (NULL dropped)."""
    lo, hi = trim_bounds(df, col, lo_q, hi_q)
    if lo is None:
        return df.limit(0)
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))


def amount_histogram(df: DataFrame, col: str = "amount", bins: int = 60) -> DataFrame:
    """Equal-width bins over the trimmed [p01, p99] range; the top edge
    falls in the last bin.  (bin, bin_lo, bin_hi, n)."""
    lo, hi = trim_bounds(df, col)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    x = F.col(col).cast("double")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    t = df.where(x.between(F.lit(lo), F.lit(hi)))
    return t.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A13 box plots: per column quartiles, whiskers (the outermost values within
    1.5 IQR of the box), the number of outliers beyond them, min and max.
    A column without values has NULLs and 0 outliers."""
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        q1, q2, q3 = q[c]
        inside = F.lit(False) if q1 is None else x.between(F.lit(q1 - 1.5 * (q3 - q1)), F.lit(q3 + 1.5 * (q3 - q1)))
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"), F.count_if(~inside).alias(f"o{i}"),
                 F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 *[F.lit(v).cast("double").alias(f"q{i}_{k}") for k, v in enumerate((q1, q2, q3))]]
        rows.append([f"'{_quote(c)}'", f"q{i}_0", f"q{i}_1", f"q{i}_2", f"wl{i}", f"wh{i}",
                     f"o{i}" if q1 is not None else "0L", f"mn{i}", f"mx{i}"])
    return _stack(df.agg(*aggs), rows, ["column", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers", "min", "max"])


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r for every pair (a < b), pairwise-complete rows (F.corr
    skips a row when either side is NULL).  One aggregation pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}")
                   for k, (a, b) in enumerate(pairs)])
    return _stack(one, [[f"'{_quote(a)}'", f"'{_quote(b)}'", f"r{k}"] for k, (a, b) in enumerate(pairs)],
                  ["col_a", "col_b", "corr"])


def alert_counts(df: DataFrame, level_col: str = "level") -> DataFrame:
    """Rows per alert level."""
    return df.groupBy(level_col).agg(F.count(F.lit(1)).alias("n"))
