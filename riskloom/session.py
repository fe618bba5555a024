"""Session conventions shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conventions every operator relies on:
#  * session time zone UTC, so timestamp_ntz -> timestamp casts are identity;
#  * ANSI mode stays on (Spark 4 default): bad casts must go through try_*;
#  * AQE on: coalesces small shuffles and splits skewed sort-merge joins.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "riskloom") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEM", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conventions(spark)
    return spark


def apply_conventions(spark: SparkSession) -> None:
    """Apply the runtime-settable part of SESSION_CONF to an existing session."""
    for k, v in SESSION_CONF.items():
        if k.startswith("spark.ui"):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: keep what it has
            pass


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application; Python workers import it by name."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        to = os.path.realpath(tempfile.mkdtemp(prefix="riskloom-"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/riskloom_core", "zip", os.path.dirname(root), os.path.basename(root)))
        _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` wins, then one set on the
    context.  Where neither is set, a local session (tests) gets a scratch
    folder; on a cluster that is an error, because a folder of the driver's own
    machine is out of the executors' reach.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        sc.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: a
    result that is used several times, and that survives the loss of an executor."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
