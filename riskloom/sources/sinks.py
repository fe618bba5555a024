"""Sinks: gold table, splits, predictions CSV, metrics tables,
staged publish.  Paths are cluster paths (shared storage), never local temp."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 5_000_000


def read_gold(spark: SparkSession, path: str, labeled_only: bool = False) -> DataFrame:
    """Parquet scan; ``labeled_only`` becomes a pushed-down filter."""
    df = spark.read.parquet(path)
    return df.where(F.col("has_label")) if labeled_only else df


def write_gold(df: DataFrame, path: str, date_col: str = "date", id_col: str = "id",
               n_files: int | None = None, mode: str = "overwrite") -> None:
    """Date-ordered Parquet: range partitions on date, each sorted by (date, id),
    so readers prune row groups on date.  Without ``n_files`` the number of
    files follows the data: adaptive execution merges small partitions, and a
    file ends after ROWS_PER_FILE rows."""
    cols = [date_col, id_col]
    ranged = df.repartitionByRange(n_files, *cols) if n_files else df.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*cols).write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def write_predictions_csv(df: DataFrame, path: str, top_k: int = 3, mode: str = "overwrite") -> None:
    """Id, risk_score, level, error and the first ``top_k`` reasons as CSV with header."""
    reasons = tuple(f"reason_{k + 1}_" for k in range(top_k))
    cols = [c for c in df.columns if c in ("id", "risk_score", "level", "error") or c.startswith(reasons)]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def read_predictions_csv(spark: SparkSession, path: str, top_k: int = 3) -> DataFrame:
    """The rows that ``write_predictions_csv`` wrote, with their types."""
    reasons = ", ".join(f"reason_{k + 1}_feature string, reason_{k + 1}_impact double, reason_{k + 1}_value string" for k in range(top_k))
    return spark.read.schema(f"id long, risk_score double, level string, {reasons}, error string").option("header", True) \
        .option("enforceSchema", False).csv(path)


def write_metrics(metrics_long: DataFrame, path: str, mode: str = "append") -> None:
    """(model, metric, value) rows appended to a metrics table."""
    metrics_long.write.mode(mode).parquet(path)


def publish(df: DataFrame, target: str, expected_rows: int | None = None) -> int:
    """Publish a new version of a table; readers see the old one or the new one, whole.

    The rows go to a folder of their own under ``<target>/versions``; its row
    count is checked there; the last step appends one row to
    ``<target>/pointers``, which names the version.  Whatever fails before that
    row leaves the published version as it was, and a retry writes another
    folder.  Older versions stay; ``read_published(back=1)`` reads the one before.
    """
    spark = df.sparkSession
    target = target.rstrip("/")
    version = uuid.uuid4().hex
    df.write.parquet(f"{target}/versions/{version}")
    n = spark.read.parquet(f"{target}/versions/{version}").count()
    if expected_rows is not None and n != expected_rows:
        raise ValueError(f"staged rows {n} != expected {expected_rows}; published version left untouched")
    last = _pointer(spark, target)
    seq = last["seq"] + 1 if last else 1
    spark.createDataFrame([(seq, version, n)], _POINTER).coalesce(1).write.mode("append").parquet(f"{target}/pointers")
    return n


_POINTER = "seq long, version string, n_rows long"


def _pointer(spark: SparkSession, target: str, back: int = 0):
    """The pointer ``back`` versions before the last, or None."""
    try:
        rows = spark.read.schema(_POINTER).parquet(f"{target}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    found = rows.orderBy(F.desc("seq"), F.desc("version")).limit(back + 1).collect()
    return found[back] if len(found) > back else None


def read_published(spark: SparkSession, target: str, back: int = 0) -> DataFrame:
    """The published version of a table (``back``: so many versions before it)."""
    target = target.rstrip("/")
    p = _pointer(spark, target, back)
    if p is None:
        raise ValueError(f"nothing published under {target}")
    return spark.read.parquet(f"{target}/versions/{p['version']}")
