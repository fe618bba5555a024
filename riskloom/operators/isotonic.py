"""Isotonic calibration without gathering the scores anywhere.

Fit: rows become distinct scores with their counts; each range partition of
them pools adjacent violators, which leaves far fewer pools, and the pools go
into fewer (or otherwise cut) ranges again, until no two neighbours violate the
order.  Pooling in any order gives the same pools, so cutting by ranges changes
nothing.  A task never holds more than about POOL_ROWS pools.

Apply: a score lies between two knots (ends of pools) and gets the value on the
line between them; the knots before and after each distinct score come from
running windows in two levels (inside a slice of the scores, and over slices).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize, ship_package

POOL_ROWS = 500_000
#: Slices of the scores in which knots are looked up.
SLICES = 512
_POOL = "lo double, hi double, s double, n double, edge boolean"


def pool(pools: list[list[float]], lo: float, hi: float, s: float, n: float) -> None:
    """Append a pool (score range, weighted sum and weight) and merge what violates the order."""
    while pools and pools[-1][2] * n >= s * pools[-1][3]:
        last = pools.pop()
        lo, s, n = last[0], s + last[2], n + last[3]
    pools.append([lo, hi, s, n])


def _pool_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pools: list[list[float]] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "s", "n"))):
            pool(pools, *row)
    if pools:
        edge = [False] * len(pools)
        edge[0] = edge[-1] = True
        cols = [pa.array([p[k] for p in pools], pa.float64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(edge)], names=["lo", "hi", "s", "n", "edge"])


def fit_isotonic(df: DataFrame, p: str = "proba", y: str = "y", weight: str | None = None) -> DataFrame:
    """Pools (lo, hi, value) of the isotonic least-squares fit of ``y`` on ``p``, a written
    table.  Rows with NULL score, label or weight are left out; without rows it is empty."""
    spark = df.sparkSession
    ship_package(spark)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull() & w.isNotNull())
    pools = rows.groupBy(F.col(p).cast("double").alias("lo")).agg(F.sum(F.col(y).cast("double") * w).alias("s"), F.sum(w).alias("n")) \
        .select("lo", F.col("lo").alias("hi"), "s", "n")
    pools = materialize(pools, "isotonic-scores")
    size = pools.count()
    shift = 0
    while size:
        parts = -(-size // POOL_ROWS)
        if parts > 1:
            parts += shift                              # other cuts than in the round before
        cut = pools.repartitionByRange(parts, "lo") if parts > 1 else pools.coalesce(1)
        out = materialize(cut.sortWithinPartitions("lo").mapInArrow(_pool_partition, _POOL), "isotonic-pools")
        pools, left = out.drop("edge"), out.count()
        if parts == 1:
            break
        # First and last pool of each partition: two rows for each POOL_ROWS pools.
        ends = sorted((r["lo"], r["s"], r["n"]) for r in out.where("edge").select("lo", "s", "n").collect())
        if all(a[1] * b[2] < b[1] * a[2] for a, b in zip(ends, ends[1:]) if a[0] < b[0]):
            break
        shift, size = (1 - shift if left > POOL_ROWS else 0), left
    return pools.select("lo", "hi", (F.col("s") / F.col("n")).alias("value"))


def apply_isotonic(df: DataFrame, pools: DataFrame, p: str = "proba", out: str = "proba_cal") -> DataFrame:
    """``df`` with ``out``: the value of the fit at each score, on the line between the knots around
    it, the outermost value beyond them; NULL for a NULL score or without any pool."""
    x = F.col(p).cast("double")
    knots = pools.select(F.explode(F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))).alias("x"), "value")
    edges = pools.agg(F.percentile_approx("lo", F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)]), 4 * SLICES).alias("e")).first()["e"]
    bounds = F.array(*[F.lit(float(e)) for e in sorted(set(edges or []))]).cast("array<double>")
    slice_of: Column = F.size(F.filter(bounds, lambda e: e <= F.col("x")))
    scores = df.where(x.isNotNull()).select(x.alias("x")).distinct()
    points = scores.select("x", F.lit(None).cast("double").alias("value"), F.lit(1).alias("wanted")) \
        .unionByName(knots.select("x", "value", F.lit(0).alias("wanted"))).withColumn("slice", slice_of)
    knot = F.when(F.col("wanted") == 0, F.struct("x", "value"))
    ends = points.groupBy("slice").agg(F.max(knot).alias("last"), F.min(knot).alias("first"))           # at most SLICES rows
    by_slice = Window.orderBy("slice")
    ends = ends.select("slice", F.max("last").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"),
                       F.min("first").over(by_slice.rowsBetween(1, Window.unboundedFollowing)).alias("from_after"))
    inside = Window.partitionBy("slice").orderBy("x")
    near = points.select("*", F.max(knot).over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("b"),
                         F.min(knot).over(inside.rangeBetween(0, Window.unboundedFollowing)).alias("a")) \
        .where("wanted = 1").join(F.broadcast(ends), "slice", "left")
    before, after = F.coalesce("b", "from_before"), F.coalesce("a", "from_after")
    near = near.select(F.col("x").alias("__x"), before.alias("b"), after.alias("a"))
    share = F.try_divide(F.col("__x") - F.col("b.x"), F.col("a.x") - F.col("b.x"))
    value = F.when(F.col("b").isNull(), F.col("a.value")).when(F.col("a").isNull() | (F.col("a.x") == F.col("b.x")), F.col("b.value")) \
        .otherwise(F.col("b.value") + (F.col("a.value") - F.col("b.value")) * share)
    return df.join(near.select("__x", value.alias(out)), x == F.col("__x"), "left").drop("__x")
