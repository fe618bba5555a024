"""Time splits, split statistics and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import SplitBoundaries
from riskloom.operators.gold import broadcast_if_small

SPLITS = ("train", "val", "test")


def _instant(s: str, end_of_day: bool = False) -> Column:
    t = F.to_timestamp(F.lit(s))
    if end_of_day:
        t = t + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return t


def split_column(date: str | Column, b: SplitBoundaries) -> Column:
    """P5 as one expression: train d <= te; val te < d <= ve; test d >= ts;
    otherwise (including NULL date) NULL.  Boundaries are midnight instants
    unless ``end_of_day``."""
    d = (F.col(date) if isinstance(date, str) else date).cast("timestamp")
    te, ve = _instant(b.train_end, b.end_of_day), _instant(b.val_end, b.end_of_day)
    ts = _instant(b.test_start)
    return (F.when(d <= te, "train").when((d > te) & (d <= ve), "val")
            .when(d >= ts, "test"))


def add_split(df: DataFrame, b: SplitBoundaries, date_col: str = "date") -> DataFrame:
    return df.withColumn("split", split_column(date_col, b))


def time_based_splits(df: DataFrame, b: SplitBoundaries, date_col: str = "date"
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P5 with the reference's three-frame signature (frames may overlap
    when test_start <= val_end, as in the reference)."""
    d = F.col(date_col).cast("timestamp")
    te, ve = _instant(b.train_end, b.end_of_day), _instant(b.val_end, b.end_of_day)
    ts = _instant(b.test_start)
    return df.where(d <= te), df.where((d > te) & (d <= ve)), df.where(d >= ts)


def split_fraud_rates(df: DataFrame, split_col: str = "split", label_col: str = "is_fraud",
                      has_label_col: str = "has_label") -> DataFrame:
    """A1: rows, labeled_rows, fraud_count, fraud_rate (0 when unlabeled) for
    every split, including empty ones.  One aggregation pass."""
    lab = F.coalesce(F.col(has_label_col).cast("boolean"), F.lit(False)) \
        if has_label_col in df.columns else F.lit(True)
    aggs = []
    for s in SPLITS:
        in_s = F.col(split_col) == s
        aggs += [F.count_if(in_s).alias(f"{s}_rows"),
                 F.count_if(in_s & lab).alias(f"{s}_lab"),
                 F.coalesce(F.sum(F.when(in_s & lab, F.col(label_col))), F.lit(0)).cast("long").alias(f"{s}_fr")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{s}', {s}_rows, {s}_lab, {s}_fr" for s in SPLITS)
    long = one.selectExpr(f"stack({len(SPLITS)}, {stack}) AS (split, rows, labeled_rows, fraud_count)")
    return long.withColumn("fraud_rate", F.coalesce(
        F.try_divide(F.col("fraud_count").cast("double"), F.col("labeled_rows").cast("double")), F.lit(0.0)))


def save_splits(df: DataFrame, out_dir: str, b: SplitBoundaries, date_col: str = "date",
                mode: str = "overwrite") -> str:
    """One write, partitioned by split; rows in no split go to split=unassigned."""
    add_split(df, b, date_col).withColumn("split", F.coalesce("split", F.lit("unassigned"))) \
        .write.mode(mode).partitionBy("split").parquet(out_dir)
    return out_dir


def hash_key(c: str | Column, seed: int = 42) -> Column:
    """Deterministic pseudo-random order key, identical in DuckDB: md5('seed:value')."""
    x = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(F.lit(f"{seed}:"), x.cast("string")))


def hash_top_n(df: DataFrame, n: int, key_col: str, seed: int = 42,
               tie_col: str | None = None) -> DataFrame:
    """The ``n`` rows with the smallest ``md5('seed:key')`` (ties by
    ``tie_col``), i.e. ``ORDER BY md5, tie LIMIT n`` - without pulling n rows
    into one task.

    md5 is uniform, so its first 4 hex digits cut the rows into 65,536
    even buckets.  Counts per bucket (map-side combined) give exclusive
    offsets on a 65,536-row table; whole buckets below the cut are kept as
    they are, and only the single bucket that straddles ``n`` is ranked.
    """
    tie_col = tie_col or key_col
    h = hash_key(key_col, seed)
    staged = df.withColumn("__h", h).withColumn("__hb", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    counts = staged.groupBy("__hb").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("__hb").alias("__ob"), "__cnt",
                         F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    j = staged.join(F.broadcast(offs), F.col("__hb") == F.col("__ob"))  # <= 65,536 rows
    whole = j.where(F.col("__off") + F.col("__cnt") <= n)
    edge = j.where((F.col("__off") < n) & (F.col("__off") + F.col("__cnt") > n))
    wr = Window.partitionBy("__hb").orderBy("__h", tie_col)
    edge = edge.withColumn("__r", F.row_number().over(wr)) \
        .where(F.col("__off") + F.col("__r") <= n).drop("__r")
    drop = ["__h", "__hb", "__ob", "__cnt", "__off"]
    return whole.drop(*drop).unionByName(edge.drop(*drop))


def sample_entities(df: DataFrame, entity_col: str, n: int, seed: int = 42) -> DataFrame:
    """O4 + J7: all rows of ``n`` pseudo-randomly chosen entities
    (hash top-n over the distinct entities, then a semi join)."""
    ents = df.select(entity_col).where(F.col(entity_col).isNotNull()).distinct()
    picked = hash_top_n(ents, n, entity_col, seed).select(F.col(entity_col).alias("__pick"))
    return df.join(broadcast_if_small(picked), F.col(entity_col) == F.col("__pick"), "left_semi")


def stratified_sample(df: DataFrame, n_total: int, label_col: str = "is_fraud",
                      id_col: str = "id", seed: int = 42) -> DataFrame:
    """O5 + U1: every positive plus hash-ordered negatives up to ``n_total``
    rows overall.  The positive count is one scalar aggregate."""
    pos = df.where(F.col(label_col) == 1)
    neg = df.where(F.col(label_col) == 0)
    n_pos = pos.count()
    n_neg = max(0, n_total - n_pos)
    return pos.unionByName(hash_top_n(neg, n_neg, id_col, seed))


def sample_rows(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """N hash-ordered rows (deterministic); ``df.sample`` is the approximate variant."""
    return hash_top_n(df, n, id_col, seed)


def sample_by_label(df: DataFrame, want: int | None, label_col: str = "is_fraud",
                    id_col: str = "id", seed: int = 42) -> DataFrame:
    """One row with the requested label, else any row."""
    if want is not None:
        hit = sample_rows(df.where(F.col(label_col) == want), 1, id_col, seed)
        if hit.take(1):
            return hit
    return sample_rows(df, 1, id_col, seed)
